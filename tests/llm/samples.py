"""Small tables with everything that may go wrong in them."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"

ENGLISH = "the cat and the dog went to the old house on the hill and then they came back home again"
GERMAN = "der hund und die katze gingen zu dem alten haus auf dem berg und kamen dann wieder nach hause"
GREEK = "ο σκύλος και η γάτα πήγαν στο παλιό σπίτι πάνω στον λόφο και γύρισαν"

TEXTS = [
    (1, ENGLISH, "en"),
    (2, ENGLISH, "en"),
    (3, GERMAN, "de"),
    (4, None, "en"),
    (5, "", None),
    (6, "   \n\t ", "de"),
    (7, "42 !? ...", "en"),
    (8, ENGLISH.upper() + "\nNew line  two spaces\tand a tab\r\n", "en"),
    (9, GREEK, "el"),
    (10, "word", "en"),
    (11, (ENGLISH + " " + GERMAN + "\n") * 400, "en"),
    (12, "=" * 3000 + " é́ 你好 \U0001f600 \x00 a\x1cb <|endoftext|>", None),
    (13, "x" * 20000, None),
    (2, ENGLISH, "en"),
    (14, "mail jo.do@mail.example.com or +1 (243) 555-5526, 4929348385146306 at 43.21.141.162", "en"),
    (None, "a row without a key", "en"),
]

#: Names that the operators use for columns of their own.
CLASHING = ["_key", "key", "block", "group", "shard", "unit", "size", "row", "ids", "spans", "_hash", "hash", "node", "host"]


def documents(spark, rows=None):
    rows = TEXTS if rows is None else rows
    data = [(key, text, lang, "src", None if text is None else len(text)) for key, text, lang in rows]
    return spark.createDataFrame(data, DOCUMENT).repartition(3)


def with_clashes(docs):
    return docs.withColumns({name: F.lit(7) for name in CLASHING})


def empty_documents(spark):
    return spark.createDataFrame([], T.StructType.fromDDL(DOCUMENT))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
