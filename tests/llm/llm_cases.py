"""Rows that every operator must take: nulls, extremes, repeats, clashing columns."""

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score string, "
          "node string, matches string, length string, position string, id string, place string")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """Deterministic words without repeats of long stretches."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + WORDS[(x >> 16) % len(WORDS)])
    return " ".join(out)


LONG = prose(99, 30000)


def rows():
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing extra columns."""
    base = prose(1, 120)
    near = base.replace(base.split()[40], "changed", 1)
    texts = [None, "", "   \n\t ", LONG, base, base, near, "one", "Übér ñandú 日本語 😀", "1234 !!! ...", prose(2, 60),
             "mail a.b@c.example.org or +1 (555) 123-4567, card 4111 1111 1111 1111 at 10.0.0.1."]
    out = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else "s", None if t is None else len(t), *["x"] * 8) for i, t in enumerate(texts)]
    return [*out, out[4], (None, base, "en", None, len(base), *["y"] * 8), (None, None, None, None, None, *[None] * 8)]
