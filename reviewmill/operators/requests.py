"""Request metadata, plans and mentions, one request per row."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.fixed_values import CATEGORY_CODES
from reviewmill.functions import names
from reviewmill.functions.dates import parse_date
from reviewmill.operators.embedding import Embedder, embed_text
from reviewmill.operators.joins import measure, sized
from reviewmill.operators.neighbours import nearest_name
from reviewmill.schema import METADATA
from reviewmill.session import cut_lineage

cloudpickle.register_pickle_by_value(names)

# Plan texts hold an array of quoted strings: [ string string, string ]. All repetitions are
# possessive: a sign is read once and never given back, so neither the length of a text nor the
# number of its strings costs stack.
STRING = r"""(?:"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+')"""
ITEM = rf"{STRING}(?:\s*+{STRING})*+"
ARRAY = rf"\[\s*+(?:{ITEM}\s*+,?+\s*+)*+\]"
# What a string is made of: surrogate pairs, other escapes, and text between them.
PIECE = (
    r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    r"|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\[\s\S]|[^\\]++"
)
# Escapes of one sign; a line break behind a backslash is left out.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "\\": "\\", "'": "'", '"': '"', "/": "/", "\n": ""}

ISO_DATE = r"\b(\d{4}-\d{2}-\d{2})\b"
NOT_A_WORD = r"[^\p{L}\p{N}_]+"
TREE_BYTES = 16 * 1024 * 1024  # of names that every task holds as a tree


def parse_metadata(text: Column) -> Column:
    """Metadata record of a JSON text; unreadable text gives a record of NULLs."""
    return F.from_json(text, METADATA)


def request_metadata(requests: DataFrame, column: str = "metadata") -> DataFrame:
    """Metadata columns of each request; dates are parsed, missing lists are empty."""
    record = parse_metadata(F.col(column))
    nothing = F.array().cast("array<string>")
    return requests.select("request_id", record.alias("m")).select(
        "request_id",
        F.coalesce(F.col("m.companies"), nothing).alias("companies"),
        parse_date(F.col("m.start_date")).alias("start_date"),
        parse_date(F.col("m.end_date")).alias("end_date"),
        F.coalesce(F.col("m.categories"), nothing).alias("categories"),
    )


def resolve_companies(
    metadata: DataFrame, companies: DataFrame, embedder: Embedder | None = None
) -> DataFrame:
    """Metadata with every mentioned company replaced by the most similar known name.

    ``metadata`` comes from :func:`request_metadata`. Each distinct mention is embedded and
    looked up once, however many requests contain it.
    """
    mentioned = metadata.select("request_id", F.posexplode("companies").alias("_pos", "mention"))
    distinct = mentioned.select("mention").distinct()
    distinct = cut_lineage(embed_text(distinct, "mention", "embedding", embedder))
    found = cut_lineage(nearest_name(distinct, companies).select("mention", "name"))
    names = mentioned.join(sized(found), "mention")
    # A request holds no more names than its own list.
    in_order = F.array_sort(F.collect_list(F.struct("_pos", "name")))
    resolved = names.groupBy("request_id").agg(
        F.transform(in_order, lambda pair: pair["name"]).alias("_names")
    )
    nothing = F.array().cast("array<string>")
    return metadata.join(resolved, "request_id", "left").select(
        *[
            F.coalesce("_names", nothing).alias("companies") if c == "companies" else F.col(c)
            for c in metadata.columns
        ]
    )


def _decoded(piece: Column) -> Column:
    """Text that one piece of a string stands for; an unknown escape is kept as it is."""
    code = F.regexp_replace(piece, r"\\[ux]", "")
    wide = F.decode(F.unhex(F.when(F.length(code) == 2, F.concat(F.lit("00"), code)).otherwise(code)), "UTF-16BE")
    simple = F.create_map(*[F.lit(part) for pair in ESCAPES.items() for part in pair])
    sign = F.substring(piece, 2, 1)
    return (
        F.when(~piece.startswith("\\"), piece)
        .when(sign.isin("u", "x") & (F.length(piece) > 2), wide)
        .otherwise(F.coalesce(simple[sign], piece))
    )


def _unquote(text: Column) -> Column:
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    pieces = F.regexp_extract_all(inner, F.lit(PIECE), F.lit(0))
    plain = F.array_join(F.transform(pieces, _decoded), "")
    return F.when(F.contains(inner, F.lit("\\")), plain).otherwise(inner)


def _item(text: Column) -> Column:
    """One step: strings that follow each other without a comma are one."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(STRING), F.lit(0)), _unquote), "")


def quoted_strings(text: Column) -> Column:
    """Strings of the first bracketed array in ``text``; empty if there is none."""
    array = F.regexp_extract(text, ARRAY, 0)
    return F.transform(F.regexp_extract_all(array, F.lit(ITEM), F.lit(0)), _item)


def parse_plan(requests: DataFrame, column: str = "plan") -> DataFrame:
    """Steps of each request's plan text, numbered from 0."""
    return requests.select(
        "request_id", F.posexplode(quoted_strings(F.col(column))).alias("step_no", "step")
    )


def plan_steps(steps: DataFrame, column: str = "step") -> DataFrame:
    """Action and arguments of each step; only the first colon separates."""
    parts = F.split(F.col(column), ":", 2)
    return steps.select(
        "request_id",
        "step_no",
        F.trim(parts[0]).alias("action"),
        quoted_strings(F.get(parts, F.lit(1))).alias("args"),
    )


def _normal(text: Column) -> Column:
    """Lower-case words with one space between them and around the whole."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), NOT_A_WORD, " ")), F.lit(" "))


def _named_by_tree(normal: DataFrame, rows: DataFrame) -> DataFrame:
    """Names in each text by one walk over its words along a tree of all names, which every task holds.

    Nothing is exploded or shuffled, and the tree is left at the first word that no name goes on with.
    """
    tree = names.word_tree((row.gram, row.name) for row in rows.select("gram", "name").collect())
    shared = normal.sparkSession.sparkContext.broadcast(tree)
    return normal.withColumn("_names", F.pandas_udf(names.search(shared), "array<string>")("_text"))


def _named_by_joins(normal: DataFrame, rows: DataFrame) -> DataFrame:
    """The same walk for names that do not fit into a task: first words and names are joined."""
    first = F.split("gram", " ")[0]
    starts = rows.groupBy(first.alias("word")).agg(F.collect_set(F.size(F.split("gram", " "))).alias("sizes"))
    words = F.split(F.trim("_text"), " ")
    each = normal.select("request_id", words.alias("_words"), F.posexplode(words).alias("place", "word"))
    begun = each.join(starts, "word").select("request_id", "_words", "place", F.explode("sizes").alias("n"))
    grams = begun.select("request_id", F.array_join(F.slice("_words", F.col("place") + 1, F.col("n")), " ").alias("gram"))
    # a question names no more companies than it has words
    named = grams.join(rows, "gram").groupBy("request_id").agg(F.array_sort(F.collect_set("name")).alias("_names"))
    return normal.join(named, "request_id", "left").withColumn("_names", F.coalesce("_names", F.array().cast("array<string>")))


def mentioned_categories(normal_text: Column) -> Column:
    """Category names whose words occur in a normal text ("other" cannot be asked for)."""
    found = [
        F.when(F.contains(normal_text, _normal(F.lit(name))), F.lit(name))
        for name, code in CATEGORY_CODES.items()
        if code > 0
    ]
    return F.array_compact(F.array(*found))


def extract_mentions(requests: DataFrame, companies: DataFrame, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """Companies, categories and dates named in each question.

    Names are found by a walk over the words of a question; they are held by every task if measured to have at
    most ``tree_bytes``, and joined otherwise. The first date in ISO form is the start, the second the
    end. This finds names as written, not paraphrases.
    """
    known = companies.select(F.trim(_normal(F.col("name"))).alias("gram"), "name").where("gram != ''")
    normal = requests.select("request_id", "question", _normal(F.col("question")).alias("_text"))
    held = measure(known).bytes <= tree_bytes
    found = _named_by_tree(normal, known) if held else _named_by_joins(normal, known)
    dates = F.regexp_extract_all("question", F.lit(ISO_DATE), F.lit(1))
    asked = found.select("request_id", "_names", dates.alias("_dates"), mentioned_categories(F.col("_text")).alias("categories"))
    return asked.select(
        "request_id",
        F.coalesce("_names", F.array().cast("array<string>")).alias("companies"),
        F.coalesce(F.get("_dates", F.lit(0)), F.lit("")).alias("start_date"),
        F.coalesce(F.get("_dates", F.lit(1)), F.lit("")).alias("end_date"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
    )
