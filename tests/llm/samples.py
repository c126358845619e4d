"""Rows with nulls, repeats, clashing names and one very long text."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use inside, and one that only differs in meaning.
    T.StructField("size", T.StringType()), T.StructField("key", T.LongType()), T.StructField("mark", T.StringType()),
    T.StructField("fp", T.StringType()), T.StructField("part", T.StringType()), T.StructField("n", T.StringType()),
    T.StructField("_row", T.StringType()), T.StructField("_id", T.StringType()), T.StructField("shard", T.StringType()),
])

ENGLISH = "the house and the garden with those old trees where we were thinking about nothing in particular"
GERMAN = "das haus und der garten mit den alten bäumen wo wir über nichts besonderes nachgedacht haben"


def rows():
    long = " ".join(f"word{i % 977} and more of it" for i in range(20_000))
    texts = [
        (1, ENGLISH, "en", "b"), (2, ENGLISH.replace(" the ", " \t the\n"), "en", "a"), (3, GERMAN, "de", "a"),
        (4, None, None, None), (5, "", "en", "a"), (6, " \n\t ", None, None), (7, long, "en", "c"), (8, long, "en", "c"),
        (None, "no id at all here", "en", "b"), (9, ENGLISH, "en", "b"), (9, ENGLISH, "en", "b"), (10, "12 34 !!", "en", "b"),
        (11, GERMAN + " ja", "de", "ü"), (11, "other text of the same id", "en", "a"), (12, "No id at all here", "en", ""),
    ]
    return [(i, t, lang, source, len(t or ""), "x", 7, "m", None, "p", "q", "r", "s", "t") for i, t, lang, source in texts]
