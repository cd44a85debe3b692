import pytest

#: Nulls, empty and blank texts, repeated rows and ids, white space, odd characters, a long text.
ODD = [
    (900001, None, None, None, None),
    (900002, "", "en", "a", 0),
    (900003, " \n\t ", "en", "a", 4),
    (900004, "one", None, "a", 3),
    (900005, "one two three four", "en", None, 18),
    (900005, "one two three four", "en", None, 18),
    (900006, "One TWO three four", "en", "z", 18),
    (900007, "a b c d e f g h i j\n\na b c d e f g h i j", "de", "b", 40),
    (900008, "日本語 テキスト 😀 é́ﬁ ▁x <s>a</s>\r\nq\x00", "ja", "b", 30),
    (900009, "12345 ... !!! $$$", "en", "c", 17),
    (None, "no id here at all but some words", "en", "c", 32),
    (900010, "word " * 30_000, "en", "c", 150_000),
]
#: Names that operators use inside, or for what they add.
USED = (
    "id", "size", "k", "node", "label", "s", "row", "n", "score", "h", "lang_pred", "n_lines", "n_kept", "before", "after", "ids", "decoded", "media", "media_type", "media_length", "corrected", "embedded",
    "row_id", "passes", "picks", "taken_text", "target", "taken", "component", "rep", "k1", "held_out", "predicted", "toxic", "fold", "grams", "line", "counts", "drops", "x", "y", "a", "b", "p", "at",
    "_size", "_row", "_text", "_lang", "_score", "_n_lines", "_n_kept", "_has_blank", "_drops", "_counts", "_had", "_keep", "_first", "_in_0", "_in_1", "in_0",
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    """The smallest documents, odd rows, near copies, and columns with names that operators use inside."""
    from pyspark.sql import functions as F

    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    texts = [r["text"] for r in real.orderBy("doc_id").limit(40).collect()]
    near = []
    for k, t in enumerate(texts):
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        near.append((910000 + k, " ".join(words), "en", "near", len(t)))
        near.append((920000 + k, t.replace("e", "i", 2), "en", "near", len(t)))
    out = real.unionByName(spark.createDataFrame(ODD + near, SCHEMA))
    return out.withColumns({c: F.lit(7) for c in USED})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
