from __future__ import annotations

from collections import Counter

import corpus_pipeline
import numpy as np

from pricetide.llm import toxicity
from pricetide.llm.common import read
from pricetide.llm.decontaminate import normalised

from .test_jaccard_join import by_hand
from .test_mixing import by_hand as mix_by_hand

SF_DIR = "/root/testdata/sf0.01"


def rows(frame):
    return [(r.doc_id, r.text, r.source) for r in frame.collect()]


def test_every_stage_against_brute_force(spark):
    """Each stage on what the one before kept, compared with a plain computation over the same rows."""
    docs = read(spark, SF_DIR, "documents")
    stages = dict(corpus_pipeline.STAGES)
    index = toxicity.fit(docs, read(spark, SF_DIR, "labels")).invert()
    clean = stages["toxicity"](spark, docs, SF_DIR)
    assert clean.columns == docs.columns
    want = sorted(r for r in rows(docs) if next(index.scores([r[1]]))[0] < 0.5)
    assert sorted(rows(clean)) == want and len(want) < docs.count()

    single = stages["ngram_jaccard_join"](spark, clean, SF_DIR)
    kept = {key for key, _, component in by_hand([(k, t) for k, t, _ in want]) if key == component}
    assert sorted(rows(single)) == sorted(r for r in want if r[0] in kept)

    tested = stages["benchmark_decontamination"](spark, single, SF_DIR)
    items = [normalised(r.text).strip() for r in read(spark, SF_DIR, "benchmark").collect()]
    left = [r for r in rows(single) if not any(item in normalised(r[1]) for item in items)]
    assert sorted(rows(tested)) == sorted(left)

    mix = stages["mixing"](spark, tested, SF_DIR)
    taken = mix_by_hand(left)
    words = {k: len(t.encode().split()) for k, t, _ in left}
    found = Counter(r[0] for r in rows(mix))
    assert {k: n * words[k] for k, n in found.items()} == {k: r[3] for k, r in taken.items() if r[3]}

    placed = stages["sharding"](spark, mix, SF_DIR).collect()
    assert Counter(r.doc_id for r in placed) == found
    filled = np.bincount([r.shard for r in placed], [r.size for r in placed], 8)
    assert filled.min() > 0


def test_run(spark):
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert 500 < len(found) and {r.shard for r in found} == set(range(8))
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
