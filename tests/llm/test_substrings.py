from marktlens.llm import substrings

A = "One two three four five six. Seven eight nine ten eleven twelve thirteen."
B = "Short one. Then another sentence of seven words is here! Ok?"
ROWS = [
    (5, f"{A}\n{B}"), (2, f"Intro words before it and {A} after"), (9, B), (1, "alpha beta gamma delta epsilon\nunique line that no other has at all"),
    (3, "x\nALPHA  beta gamma delta epsilon\ny"), (4, None), (6, ""), (None, A), (5, f"{A}\n{B}"), (8, "\n\n \n"), (10, (A + " ") * 3000), (11, "no no. " * 50),
    (12, f"aaa\n{B}\nbbb"), (13, f"{B}\n\n{B}\n"), (14, f"\n{A}\n\n{A}\nend"), (15, "\u6211\u4eec\u4eca\u5929\u53bb\u516c\u56ed\u6563\u6b65\u5929\u6c14\u5f88\u597d\u5927\u5bb6\u90fd\u9ad8\u5174\u3002\u56de\u5bb6\u3002"), (16, "\u524d\u6587\u3002\u6211\u4eec\u4eca\u5929\u53bb\u516c\u56ed\u6563\u6b65\u5929\u6c14\u5f88\u597d\u5927\u5bb6\u90fd\u9ad8\u5174\u3002\u540e\u6587"),
    (17, 'He said (no.) One two three four five six seven "eight." Then'), (18, 'We left (no.) One two three four five six seven "eight." Never'), (19, "x" * 170), (20, "y\n" + "x" * 170),
]


def slow_size(piece):
    dense = sum("\u0e00" <= c <= "\u0eff" or "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" for c in piece)
    return max(1, dense // 2 + (len(piece) - dense) // 20)


def slow_units(text, min_words, line_words):
    """Units, character by character."""
    sentences, found, line_start = [], [], 0
    for i in range(len(text) + 1):
        if i < len(text) and text[i] != "\n":
            continue
        line, start, total = text[line_start:i], 0, 0
        j = 0
        cuts = []
        while j < len(line):
            if line[j] in ".!?\u2026":
                k = j
                while k < len(line) and line[k] in ".!?\u2026":
                    k += 1
                while k < len(line) and line[k] in "\"'\u2019\u201d\u00bb)]":
                    k += 1
                if k == len(line) or line[k].isspace():
                    cuts.append(k)
                    j = k
                    continue
            elif line[j] in "\u3002\uff01\uff1f":
                while j + 1 < len(line) and line[j + 1] in "\u3002\uff01\uff1f\u300d\u201d":
                    j += 1
                cuts.append(j + 1)
            j += 1
        for e in [*cuts, len(line)]:
            pieces = line[start:e].split()
            if pieces:
                n = sum(map(slow_size, pieces))
                sentences.append((line_start + start, line_start + e, " ".join(pieces).lower(), n))
                total += n
            start = e
        if line.strip() and total >= line_words:
            found.append((line_start, i, ("line", " ".join(line.split()).lower())))
        line_start = i + 1
    for i in range(len(sentences)):
        for j in range(i, len(sentences)):
            if sum(x[3] for x in sentences[i : j + 1]) >= min_words:
                found.append((sentences[i][0], sentences[j][1], ("passage", " ".join(x[2] for x in sentences[i : j + 1]))))
                break
    return found


def brute(rows, min_words=8, line_words=5):
    docs = sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    first, gone = {}, {}
    for d, t in docs:
        for s, e, form in sorted(slow_units(t or "", min_words, line_words)):
            if first.setdefault(form, (d, t, s, e)) != (d, t, s, e):
                gone.setdefault((d, t), set()).update(range(s, e))
    return gone


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    return substrings.dedup_substrings(docs.repartition(5)).collect()


def check(spark, rows):
    gone, got = brute(rows), run(spark, rows)
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t)
    for r in got:
        cuts = {i for x in r.removed for i in range(x.start, x.end)}

        def fits(t):
            """Only what is repeated goes, and line ends that a removal leaves twice; kept and removed rebuild the text."""
            more = cuts - gone.get((r.doc_id, t), set())
            whole = sorted([(x.start, x.end, x in r.kept) for x in (*r.kept, *r.removed)])
            parts = "".join((t or "")[s:e] for s, e, k in whole if k)
            return gone.get((r.doc_id, t), set()) <= cuts and all((t or "")[i] == "\n" for i in more) and parts == (r.text or "") and (r.text is None) == (t is None) and [x[1] for x in whole[:-1]] == [x[0] for x in whole[1:]] and sum(e - s for s, e, _ in whole) == len(t or "")

        assert any(map(fits, texts[r.doc_id])), r
        assert r.n_removed_chars == len(cuts)


def test_units():
    got = substrings.units("A b c. D e f g h. I.\nj k l m n", 5, 5)
    assert [x[2] for x in got] == ["l a b c. d e f g h. i.", "l j k l m n", "p a b c. d e f g h.", "p d e f g h.", "p i. j k l m n", "p j k l m n"]


def test_matches_brute_force(spark):
    check(spark, ROWS)


def test_empty(spark):
    assert run(spark, []) == []


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_offsets_rebuild_the_text(spark):
    n = 0
    for r in run(spark, [x for x in ROWS if x != (None, A)]):
        t = dict((d, t) for d, t in ROWS)[r.doc_id]
        if t is not None:
            assert r.text == "".join(t[x.start : x.end] for x in r.kept) and r.n_removed_chars == len(t) - len(r.text)
            n += bool(r.removed)
    assert n > 5
    assert substrings.cut("aaa\nDUP LINE\nbbb", [(4, 12)]) == ("aaa\nbbb", [(0, 4), (13, 16)], [(4, 13)])
    assert substrings.cut("DUP\nb", [(0, 3)]) == ("\nb", [(3, 5)], [(0, 3)]) and substrings.cut("DUP", [(0, 3)]) == ("", [], [(0, 3)])


def test_scripts_without_blanks(spark):
    got = {r.doc_id: r.n_removed_chars for r in run(spark, ROWS) if r.doc_id in (15, 16, 18, 20)}
    assert got[15] == 0 and got[16] == 19 and got[18] > 40 and got[20] == 170


def test_passage_inside_other_text(spark):
    passage = " ".join(f"Word{i} word{i + 1} word{i + 2} word{i + 3} word{i + 4}." for i in range(0, 60, 5))
    got = {r.doc_id: r.n_removed_chars for r in run(spark, [(i, f"head{i} tail{i} " * 9 + passage + f" rest{i}") for i in range(40)])}
    assert got[0] == 0 and all(got[i] > len(passage) * 0.8 for i in range(1, 40))
