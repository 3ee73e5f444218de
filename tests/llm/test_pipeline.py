"""The pipeline stage by stage, each on its own input, against brute force."""

import corpus_pipeline
from provenlake.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.documents(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "packing"]
    columns = docs.schema
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = common.stash(stage(spark, docs, SF), name)
        assert docs.schema == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and len(after) >= 0.5 * len(before)
        if name == "near_duplicates":
            sets = {}
            for i, t in before.items():
                w = t.encode().lower().split()
                sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
            link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and bool(sets[a] and sets[b])
            assert all(any(link(i, j) for j in before if j < i) for i in set(before) - set(after))
            assert not any(link(i, j) for i in after for j in after if j < i)
        if name == "repeats":
            seen = set()
            for i in sorted(before):
                b = before[i].encode()
                own = [b[s : s + 100] for s in range(len(b) - 99)]
                repeated = any(w in seen or w in own[:k] for k, w in enumerate(own))
                assert (len(after[i].encode()) < len(b)) == repeated or repeated
                seen.update(own)
        before = after
    packed = corpus_pipeline.STAGES[3][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(before)
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
