"""What the Jaccard join leaves in the shared folder."""

import random
from pathlib import Path

from tidemark.llm import common, jaccard


def test_tables_go_when_no_step_reads_them(spark, monkeypatch):
    """Prefixes, index lists and sets are most of the join's disk; the lists are gathered in parts."""
    rng = random.Random(11)
    texts = [None, "", "a"]
    for _ in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        texts += [" ".join(words), " ".join(words), " ".join([*words[:50], "x", *words[51:]]), " ".join([*words[30:], *words[:20]])]
    docs, written, plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [], common.written

    def noted(df, name, clean=False):
        out = plain(df, name, clean)
        folders = {f.rsplit("/", 1)[0].removeprefix("file://") for f in out.inputFiles()}
        written.extend((name, folder) for folder in folders)
        return out

    monkeypatch.setattr(common, "written", noted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_links(docs, width=3, percent=80).collect()}
    left = {name for name, folder in written if Path(folder).exists()}
    assert not left & {"prefixes", "histograms", "lists", "shared", "placed", "near", "near-sets", "far", "far-sets"}, left
    assert len([n for n, _ in written if n == "shared"]) == 3

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()

    sets, want = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in range(4):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    want[i] = min(want[i], want[j])
    assert got == dict(enumerate(want)) and len(set(want)) < len(want)
