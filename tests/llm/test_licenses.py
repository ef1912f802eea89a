"""License scans on small texts; the query itself is compared with SQL."""

from tidewire.llm import licenses


def test_scan(spark):
    mit = next(t for t, label in licenses.NOTICES.items() if label == "mit")
    rows = [
        (1, "The GNU General Public License. the gnu, general public license"),
        (2, "Apache License and MIT-License; apache\nlicense"),
        (3, mit.replace("granted", "GRANTED, hereby,").replace("free of charge", "free charge")),
        (4, None), (5, ""), (6, "cc"), (7, "gnu general public"), (8, "cc by " * 20000), (1, "cc by"), (1, "cc by"), (None, "All rights reserved."),
    ]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, place int, template string")
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) for r in licenses.scan(docs).collect()), key=repr)
    words = len(mit.split())
    wanted = [
        (1, 10, 2, 1, 6, "gpl", "gpl"), (2, 7, 3, 0, 5, "apache,mit", "apache,mit"), (3, words, 0, None, None, "", "mit"), (4, 0, 0, None, None, "", ""),
        (5, 0, 0, None, None, "", ""), (6, 1, 0, None, None, "", ""), (7, 3, 0, None, None, "", ""), (8, 40000, 20000, 0, 39998, "cc-by", "cc-by"),
        (1, 2, 1, 0, 0, "cc-by", "cc-by"), (1, 2, 1, 0, 0, "cc-by", "cc-by"), (None, 3, 0, None, None, "", "all-rights-reserved"),
    ]
    assert got == sorted(wanted, key=repr)
    assert all(0 <= r.score <= 1 for r in licenses.scan(docs).collect())
    assert licenses.scan(docs.limit(0)).collect() == []
