"""Small messy collections: nulls, empty and long texts, repeated rows, clashing column names."""

import random

import pytest

WORDS = {
    "en": "the of and to in that was with for are heating stone river under ready house then".split(),
    "de": "der die und nicht ein ich werden haus straße über schön zwischen fluß acht licht".split(),
}
CLASHES = "node string, signature string, part string, text_key string, spans string, row_key string, label string"


def prose(seed: int, n: int, lang: str = "en") -> str:
    """Sentences of invented words around the common ones of a language."""
    rng, out = random.Random(f"{lang}{seed}"), []
    for i in range(n):
        word = rng.choice(WORDS[lang]) if rng.random() < 0.4 else "".join(
            rng.choice(WORDS[lang])[:3] for _ in range(rng.randint(2, 3))
        )
        out.append(word + (". " if i % 9 == 8 else " "))
    return "".join(out).strip()


def edited(text: str, seed: int, changes: int) -> str:
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def messy_rows() -> list[tuple]:
    base, passage = prose(1, 220), prose(2, 70)
    texts = [
        base,
        base,
        edited(base, 1, 2),
        edited(base, 2, 3),
        edited(base, 3, 30),
        base.upper(),
        prose(3, 150) + "\n" + passage + "\n" + prose(4, 90),
        passage + "\n" + prose(5, 120),
        prose(6, 40) + "\n" + passage,
        None,
        "",
        " \n\t ",
        "one two",
        "one two",
        "...!!! 123 ???",
        prose(7, 300, "de"),
        prose(8, 150, "de"),
        prose(9, 12_000),
        "same same same same same same same same same same " * 40,
        "ab" * 150 + " " + "ab" * 150,
        "naïve ½ café 你好 \U0001f600 it's can't <|endoftext|> x́ " * 6,
        prose(10, 5),
        prose(11, 6),
    ]
    rows = [
        (i, t, "de" if i in (15, 16) else "en", f"src{i % 3}", None if t is None else len(t))
        for i, t in enumerate(texts)
    ]
    rows.append(rows[2])  # a repeated row
    rows.append((6, prose(12, 130), None, None, None))  # an id with a second text
    rows.append((None, edited(base, 5, 2), "en", "src0", 1))
    rows.append((None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(*row, *["x"] * 7) for row in messy_rows()]
    return spark.createDataFrame(rows, f"{columns}, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
