"""Inverted lists of the near-duplicate join: never stored with their sets."""

from __future__ import annotations

import random

from billwright.llm import jaccard_join


def test_lists_are_not_carried_with_the_sets(spark):
    """A text of 600 words has hundreds of list keys; its stored row must not hold them."""
    rng = random.Random(5)
    words = [str(rng.randrange(10**6)) for _ in range(600)]
    near = [*words[:300], "other", *words[301:]]
    far = [str(rng.randrange(10**6)) for _ in range(600)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    rows += [rows[1], rows[1], (None, rows[0][1])]  # repeated rows, a null id
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard_join.node_sets(frame)
    assert sum(len(r.node) + len(r.sketch) for r in sets.collect()) < 6 * 600
    assert not [f.name for f in sets.schema if f.dataType.typeName() == "array"]
    found = [(r.doc_id, r.component_id) for r in jaccard_join.linked_components(frame).collect()]
    assert sorted(found, key=str) == [(1, 1), (2, 1), (2, 1), (2, 1), (3, 3), (None, 1)]
