"""Rows with nulls, copies, odd characters, very long texts and columns of clashing names."""

import random

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, node string, shard int, ids string, words string, item string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("ab bc cd de ef fg gh hi ij jk kl lm mn no op pq qr rs st tu uv vw wx xy yz".split()) + str(rng.randint(0, 99)) for _ in range(n))


def texts():
    """Nulls, empty and very long texts, exact and near copies, shared passages, text of few words, odd characters."""
    base, long = words(120, 1), words(30_000, 2)
    near = base.split()
    near[60] = "changed"
    return [
        None,
        "",
        "   \n\t ",
        "one",
        "One two  THREE",
        base,
        base,
        " ".join(near),
        base.upper(),
        words(120, 3) + " " + base[:500],
        long,
        "é ü ñ 日本 😀   x",
        "a" * 5000,
        "<|endoftext|> x\n\n\ny  z",
        words(90, 4),
        "idiot you are a moron and stupid",
    ]


def messy_rows():
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, i, "n", -i, "x", None, "y") for i, t in enumerate(texts())]
    return [*rows, rows[5], (None, texts()[5], None, None, None, 0, "", 0, "", "", "")]  # a repeated row, and a null doc_id
