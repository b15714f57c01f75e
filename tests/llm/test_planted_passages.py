"""Passages of over 50 words in several documents: what is removed, what is reported."""

import random

from tempora.llm import substrings


def test_passages_are_reported_and_removed_from_400_bytes_on(spark):
    rng = random.Random(6)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "io", "u")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    texts = [[word() for _ in range(rng.randint(120, 400))] for _ in range(120)]
    planted = {}
    for k in range(20):
        passage = [word() for _ in range(rng.randint(51, 80))]
        for i in (3 * k, 3 * k + 1, 3 * k + 2):
            at = rng.randrange(len(texts[i]))
            texts[i][at:at] = passage
            planted[i] = len(" ".join(passage))
    made = substrings.remove_repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in made.collect()}
    assert all(rows[i]["n_repeated"] >= planted[i] for i in planted if planted[i] >= 256)
    assert all(rows[i]["n_removed"] >= planted[i] for i in planted if planted[i] >= 400)
    assert not any(rows[i]["n_removed"] for i in planted if planted[i] < 398)
    assert not any(rows[i]["n_removed"] or rows[i]["n_repeated"] for i in range(60, 120))
    assert min(planted.values()) > 256 and max(planted.values()) > 400 > min(planted.values())
