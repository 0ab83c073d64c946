"""marktlens: audience building, campaign reporting and text-corpus operators as Spark jobs."""
