"""Contact resolution: raw cards become one contact for each e-mail address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marktlens.functions.text import bad_email


def verdict(email: Column) -> Column:
    """EMPTY, INVALID or OK."""
    mail = F.lower(F.trim(email))
    return F.when(F.coalesce(mail, F.lit("")) == "", "EMPTY").when(bad_email(mail), "INVALID").otherwise("OK")


def checked(cards: DataFrame) -> DataFrame:
    """Cards (id, cb_id, email, ...) with their address in normal form and a verdict: EMPTY, INVALID or OK."""
    return cards.withColumn("verdict", verdict(F.col("email"))).withColumn("email", F.lower(F.trim("email")))


NAMES = ("company_name", "city", "land")
LISTS = ("phones", "websites", "categories", "description")
_BEFORE = -(2**63)  # the place of what a contact holds already: before all cards


def _fold(rows: DataFrame) -> DataFrame:
    """Contacts from rows (email, id, names, lists, n_cards, pairs). All that a row says is exploded once, by kind; each value of an address and
    kind is reduced to its first mention (pairs to their last card) before the address gathers them, so that an address with a third of all
    cards costs one row for each value."""

    def said(kind: str, v: Column, at: Column, card: Column, n: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("v"), at.cast("int").alias("at"), card.cast("long").alias("card"), n.cast("long").alias("n"))

    def listed(c: str) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v, i: said(c, v, i, F.lit(None), F.lit(0)))

    none = F.lit(0)
    names = F.filter(F.array(*[said(c, F.col(c), none, F.lit(None), none) for c in NAMES]), lambda x: F.coalesce(F.trim(x["v"]), F.lit("")) != "")
    pairs = F.transform(F.filter("pairs", lambda p: p["cb_id"].isNotNull()), lambda p: said("pairs", p["cb_id"], none, p["card_id"], none))
    count = F.array(said("", F.lit(None), none, F.lit(None), F.col("n_cards")))
    each = rows.select("email", "id", F.inline(F.concat(names, *map(listed, LISTS), pairs, count)))
    each = each.groupBy("email", "kind", "v").agg(F.min(F.struct("id", "at")).alias("first"), F.max("card").alias("card"), F.sum("n").alias("n"))
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    gathered = lambda kind: F.transform(F.array_sort(F.collect_list(of(kind, F.struct("first", "v")))), lambda x: x["v"])
    held = F.array_sort(F.collect_list(of("pairs", F.struct(F.col("v").cast("long").alias("cb_id"), F.col("card").alias("card_id")))))
    out = each.groupBy("email").agg(*[F.min_by("v", of(c, F.col("first"))).alias(c) for c in NAMES], *[gathered(c).alias(c) for c in LISTS], F.sum("n").alias("n_cards"), held.alias("pairs"))
    return out.withColumn("description", F.array_join("description", "\n\n")).withColumn("pairs", F.when(F.size("pairs") > 0, F.col("pairs")))


def _paragraphs(df: DataFrame) -> DataFrame:
    return df.withColumn("description", F.filter(F.split("description", "\n\n"), lambda x: x != ""))


def _valid(cards: DataFrame) -> DataFrame:
    pair = F.array(F.struct(F.col("cb_id").cast("long").alias("cb_id"), F.col("id").cast("long").alias("card_id")))
    return _paragraphs(checked(cards).filter("verdict = 'OK'")).withColumn("n_cards", F.lit(1).cast("long")).withColumn("pairs", pair)


def resolve(cards: DataFrame) -> DataFrame:
    """One contact for each valid address, the cards taken in order of their ids: name, city and land are the first ones
    given; phones, websites and categories the union in order; the description grows by paragraphs that are new; of
    several cards of one pair the last one counts.

    cards: id, cb_id, email, company_name, city, land, phones, websites, categories, description."""
    return _fold(_valid(cards))


def resolve_into(contacts: DataFrame, cards: DataFrame) -> DataFrame:
    """The contacts (as `resolve` gives them) that a batch of cards makes or touches, as they are afterwards: what a contact holds
    comes before what the cards add. Contacts that no card names are neither folded nor returned; the result replaces rows by
    e-mail address, also from within foreachBatch."""
    new = _valid(cards)
    held = contacts.join(new.select("email").distinct(), "email", "left_semi")
    columns = ["email", *NAMES, *LISTS, "n_cards", "pairs"]
    return _fold(new.select("id", *columns).unionByName(_paragraphs(held).select(F.lit(_BEFORE).cast("long").alias("id"), *columns)))


def outcome(cards: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of a batch: addresses EMPTY, INVALID, CREATED and UPDATED (known ones); cards of one new address create it once. Cards
    are counted by address before anything is joined."""
    n = checked(cards).groupBy("email", "verdict").agg(F.count("*").alias("n"))
    rows = n.join(known.select(F.lower(F.trim("email")).alias("email"), F.lit(True).alias("_known")).distinct(), "email", "left")
    ok = F.col("verdict") == "OK"
    made = F.when(ok & F.col("_known").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")
    kinds = F.array(F.struct(F.lit("CREATED").alias("outcome"), made.alias("n")), F.struct(F.when(ok, "UPDATED").otherwise(F.col("verdict")).alias("outcome"), (F.col("n") - made).alias("n")))
    return rows.select(F.inline(kinds)).groupBy("outcome").agg(F.sum("n").alias("n")).filter("n > 0")
