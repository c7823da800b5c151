import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) rows, with columns whose names clash with results."""

    def build(rows, parts=2):
        full = [(i, t, "en", f"s{(i or 0) % 3}" if i != 7 else None, len(t or ""), 1, True, 0.5) for i, t in rows]
        return spark.createDataFrame(full, DDL).repartition(parts)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, runs, and every edge."""
    r = random.Random(5)
    words = [a + b for a in ("ba", "ko", "mi", "tu", "re", "Zo") for b in ("la", "ni", "so", "pe", "ß", "ñ.")]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = say(50), say(120)
    rows = [(i, say(r.randint(1, 90))) for i in range(1, 25)]
    rows += [(30 + i, f"{say(20)}\n{passage} {say(15)}") for i in range(4)]
    rows += [(40 + i, base) for i in range(3)]
    rows += [(50 + i, " ".join(w if k != 7 * i else "new" + str(i) for k, w in enumerate(base.split()))) for i in range(8)]
    rows += [(70, None), (71, ""), (72, " \t\n "), (73, "a"), (74, "a b c d e"), (75, "la " * 90), (76, "la " * 90), (77, say(3000)), (78, f"  {say(40)}   {say(40)}\r\n{say(3)}   x"), (79, passage), (None, say(30))]
    rows += [(24, rows[23][1])]  # a repeated row
    return rows
