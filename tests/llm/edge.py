"""Documents with every awkward case, and a small vocabulary to make more."""

import random

LONG = " ".join(f"word{i % 5000} and" for i in range(60_000))
PROSE = ("the river bends twice before the old mill and then runs straight to the harbour where small boats wait for the "
         "tide and the gulls quarrel over what the fishermen leave behind on the stones of the quay").split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(PROSE)}{rng.randrange(40)}" for _ in range(n)) + "."


def edge_rows():
    """(doc_id, text, lang, source)"""
    base = prose(1, 120).split()
    near = list(base)
    near[60] = "changed"
    far = base[:60] + prose(2, 60).split()
    return [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n\x0b ", None, "b"), (4, "only three words", "en", "b"),
        (5, " ".join(base), "en", "c"), (6, " ".join(base), "de", "a"), (7, " ".join(near), "en", "c"),
        (8, " ".join(far), "en", "ü"), (9, LONG, "fr", "b"), (10, "\n".join(["same line again. yes it is!"] * 30), "en", "c"),
        (11, "SHOUT!! <|im_end|> \\ <b>né</b> ŉ İ 日本語 😀 \x00 x", "en", "a"), (None, "row without an id", "en", "a"),
        (12, prose(3, 40), "en", "c"), (12, prose(3, 40), "en", "c"), (13, "only three words", "en", "a"),
        (14, prose(4, 9), "de", "z"), (15, "a\n\nb\r\nc", "en", "z"),
    ]


EXTRA = ", size long, kept boolean, node string, digest string, length int, label int, times int, n_words string, score string"


def edge_docs(spark):
    rows = [(*r, 7, False, "n", "d", 3, 1, 9, "w", "s") for r in edge_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string" + EXTRA)


def no_docs(spark):
    return edge_docs(spark).limit(0)
