"""Awkward rows that every operator must take: nulls, empties, long texts, ties, repeats, clashing columns."""

import random

WORDS = "alpha beta gamma delta river stone cloud forest engine market paper window garden letter signal harbor".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.05) for _ in range(n))


def texts() -> list[str | None]:
    base = prose(1, 120)
    words = base.split()
    near = " ".join("CHANGED" if i == 60 else w for i, w in enumerate(words))
    return [
        base, base, near, None, "", "   \n\t ", "one two", "one two", prose(2, 5000), prose(3, 90) + "\n" + base, "éè \U0001f600 naïve " + prose(4, 70),
        "a b c\na b c\na b c", prose(5, 60).upper(), " ".join(["same"] * 200), prose(6, 300) + "\n" + prose(7, 40) + "\n\n" + prose(7, 40),
    ]


def documents(spark):
    """Repeated rows, a null id and columns whose names operators might use themselves."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}") for i, t in enumerate(texts())]
    rows += [(0, texts()[0], None, "s0"), (None, prose(9, 80), "en", None), (None, None, None, None)]
    extra = [(*r, len(r[1] or ""), "x", 1, "y") for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, n string, component int, quality string")


def empty(spark):
    return documents(spark).limit(0)
