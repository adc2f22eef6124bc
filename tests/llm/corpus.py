"""Small corpora and plain Python forms of what the operators compute."""

import random
import re
import string

DOCS = "doc_id long, text string, lang string, source string"
_lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_lower))


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Null, empty, wordless, repeated and very long texts."""
    long = sentence(random.Random(1), 30_000, 10**6)
    return [(1, None, "en", "src1"), (2, "", None, None), (3, " \n\t ", "de", "src1"), (4, "*** !!!", "en", "src2"), (5, "same words here to see twice", "en", "src1"), (5, "same words here to see twice", "en", "src1"), (6, "same words here to see twice", "fr", "src3"), (None, "no id at all", "en", "src1"), (7, long, "en", "src0"), (8, "Éa ß 😀 café", "fr", "x")]
