"""Decontamination by a benchmark of more n-grams than one block holds."""

import random

from tiercraft.llm import decontaminate


def test_blocks_are_bounded_and_give_the_same_hits(spark, awkward, monkeypatch):
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "one"), (3, " ".join(words[100:140]))], "item_id long, text string")
    rows = [(20 + i, " ".join(["x", *words[p:p + 30], "y"]), "en", "s", 1) for i, p in enumerate((0, 105, 900, 2960, 105))]
    extra = [c for c in awkward.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    more = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], awkward.schema)
    docs = awkward.union(more).repartition(3)
    sizes = []

    init = decontaminate.GramSet.__init__

    def counted(self, rows):
        sizes.append(len(rows))
        init(self, rows)

    def result(**options):
        out = decontaminate.find_hits(docs, bench, **options)
        assert out.columns.count("hits") == 1
        return sorted((r.doc_id or 0, r.text or "", r["n_words"], list(r["hits"]), list(r["items"])) for r in out.collect())
    want = result()
    monkeypatch.setattr(decontaminate.GramSet, "__init__", counted)
    assert result(max_grams=4000) == want and len(sizes) > 2
    assert max(sizes) <= 4000 and sum(sizes) == 2988 + 1 + 28
    assert max(sizes) < 2988
