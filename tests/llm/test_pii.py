import hashlib
import re

from pyspark.sql import functions as F
from samples import TEXTS, documents, empty_documents, rows_of, with_clashes

from reviewmill.llm import pii

# The forms of the contract as they are written there.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRICKY = [
    "a@b.c_x@y.z, x@y@z.com .@-.- a@b..c a.b@c.d.e.f@g.h %@%.com",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 0000255.0.0.0 999999999999.1.1.1",
    "4929 3483 8514 6306 4929-3483-8514-6307 4929  348385146306 79927398713 0000000000000000",
    "+1 (243) 555-5526 +1 +12 +123 45 ++49 30 1234567. +1.2.3.4.5.6.7.8.9 +1-----2 +123456789012345678",
    "é 😀 jo@example.com 😀 10.0.0.1 end",
    "jo@" + "a" * 9000 + ".b " + "1 " * 4000 + "c" * 30000 + " +1" + " " * 9000 + "2",
    "x@" * 3000 + "y.z",
    "@ + . 1 - @.com +(1) 1@2.3",
]


def base(text):
    def fits(kind, match):
        digits = re.sub(r"[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and luhn % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    found = [
        (m.start(), number, f"{kind}:{m.start()}:{m.end()}")
        for number, (kind, form) in enumerate(FORMS.items())
        for m in re.finditer(form, text)
        if fits(kind, m[0])
    ]
    return [listed for *_, listed in sorted(found)]


def test_base_against_python(spark):
    rows = TEXTS + [(100 + i, t, None) for i, t in enumerate(TRICKY)]
    for row in pii.find(with_clashes(documents(spark, rows))).collect():
        wanted = base(next(t or "" for k, t, _ in rows if k == row.doc_id))
        assert row.spans.split(",") == (wanted or [""]), row.doc_id
        assert row.base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest()
        counts = [sum(w.startswith(kind + ":") for w in wanted) for kind in FORMS]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
    assert pii.find(empty_documents(spark)).count() == 0


def learnable():
    rows = [(i, f"Please write: my contact is user{i}@mail.example.com today", "en") for i in range(6)]
    rows += [(10 + i, f"please note, my contact is member-77{i}31 as always", "en") for i in range(2)]
    rows += [(20 + i, f"the part number was ABC-{i}7731 in stock", "en") for i in range(8)]
    rows += [(30, "Reach me, my contact is (zeta9931x) or so", "en"), (31, "my contact is nobody", "en")]
    rows += [(40 + i, f"the order said user{i}@mail.example.com and more", "en") for i in range(2)]
    return rows + [(60, "the order said 2024-55 and more", "en")]


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = learnable()
    found = {r.doc_id: r for r in pii.find(documents(spark, rows)).collect()}
    texts = {k: t for k, t, _ in rows}
    marked = {
        k: [texts[k][int(a) : int(b)] for kind, a, b in (s.split(":") for s in r.spans.split(",") if s) if kind == "id"]
        for k, r in found.items()
    }
    assert marked[10] == ["member-77031"] and marked[11] == ["member-77131"] and marked[30] == ["zeta9931x"]
    assert not any(marked[k] for k in marked if k not in (10, 11, 30))
    assert all(found[k].n_found == len(marked[k]) for k in marked)
    assert all(found[i].n_email == 1 for i in range(6))


def test_contexts_without_seeds_are_reached_over_found_identifiers(spark):
    rows = [(i, f"Please write: my contact is user{i}@mail.example.com today", "en") for i in range(8)]
    rows += [(10 + i, f"now my contact is member-77{i}31 today", "en") for i in range(4)]
    rows += [(20 + i, f"the membership number is member-77{i}31 today", "en") for i in range(9)]
    rows += [(30 + i, f"her customer code was member-77{i}31 today", "en") for i in range(4, 9)]
    rows += [(40, "her customer code was third-4711 today", "en")]
    rows += [(50 + i, f"the part number was ABC-{i}7731 in stock", "en") for i in range(8)]
    rows += [(60 + i, f"some price tag member-77{i}31 in stock", "en") for i in range(3)]
    rows += [(70 + i, f"some price tag EUR-{i}99.50 in stock", "en") for i in range(9)]
    found = {r.doc_id: r.n_found for r in pii.find(documents(spark, rows)).collect()}
    assert {k for k, n in found.items() if n} == {*range(10, 14), *range(20, 29), *range(34, 39), 40}
    assert all(pii.find(documents(spark, rows[:8] + rows[12:])).select("n_found").toPandas()["n_found"] == 0)


def test_contexts_of_long_words_wide_gaps_and_line_starts(spark):
    long, wide = "Krankenversicherungsnummer", " " * 50
    cases = {
        "before {} text": "my contact is {}",
        "%s: {}" % long: "Seine %s: {} heute" % long,
        "account": "the account number:%s{} today" % wide,
        "far": "the%s account%s number%s{} today" % (wide, " " * 5000, "\t" * 70),
        "start": "Mobil: {} now",
        "line": "some words %d before\nReference: {}\nmore",
        "wrapped": "as was her\nlabel {} today",
        "broken": "this is their mark\n\n{} today",
        "glued": "x" * 5000 + " " + "y" * 5000 + ":{}",
    }
    rows, wanted = [], {}
    for n, form in enumerate(cases.values()):
        for i in range(6):
            rows.append((100 * n + i, form.replace("%d", f"w{'abcdef'[i]}").replace("{}", f"user{n}x{i}@mail.example.com"), "en"))
        token = f"key-{n}-" + "k" * 50 + "9731" * 20
        text = form.replace("%d", "other").replace("{}", token)
        rows.append((100 * n + 50, text, "en"))
        wanted[100 * n + 50] = text.replace(token, "[ID]")
    rows.append((9000, "no context was learnt for key-55-9731 here", "en"))
    rows.append((9001, "key-56-9731\n'key-57-9731", "en"))
    rows.append((9002, "some words as was\nlabel key-58-9731 today", "en"))
    found = {r.doc_id: r.text for r in pii.mask_documents(documents(spark, rows)).collect()}
    texts = {k: t for k, t, _ in rows}
    wanted[9002] = texts[9002].replace("key-58-9731", "[ID]")
    assert sorted(k for k, t in found.items() if "[ID]" in t) == sorted(wanted)
    assert [k for k in wanted if found[k] != wanted[k]] == []


def test_copies_of_one_document_teach_nothing(spark):
    rows = [(i, "my contact is user1@mail.example.com today", "en") for i in range(50)]
    rows += [(90, "my contact is member-77031 today", "en")]
    assert {r.n_found for r in pii.find(documents(spark, rows)).collect()} == {0}


def test_masking(spark):
    rows = learnable() + TEXTS[3:6] + [(70, "😀 jo@example.com 😀 10.0.0.1, card 4929 3483 8514 6306!", None)]
    docs = with_clashes(documents(spark, rows))
    found = pii.mask_documents(docs)
    assert found.columns == docs.columns
    masked = {r.doc_id: r for r in found.collect()}
    assert masked[0].text == "Please write: my contact is [EMAIL] today"
    assert masked[10].text == "please note, my contact is [ID] as always"
    assert masked[70].text == "😀 [EMAIL] 😀 [IP], card [CARD]!"
    assert masked[20].text == dict((k, t) for k, t, _ in rows)[20]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in masked.values())
    assert rows_of(pii.mask_documents(empty_documents(spark))) == []


def test_only_dataframe_functions(spark):
    plan = pii.find(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_luhn(spark):
    rows = spark.createDataFrame([("79927398713",), ("79927398710",), ("0",)], "d string")
    assert [r[0] for r in rows.select(pii._luhn(F.col("d"))).collect()] == [True, False, True]


def test_many_spans_in_one_text(spark):
    pieces = ["jo{0}@mail.example.com", "10.0.{1}.7", "+49 (30) 1234{0}", "4929 3483 8514 6306", "key-{0}-97", "😀 word", "é\n"]
    text = " ".join(pieces[i * i % 11 % 7].format(10000 + i, i % 256) for i in range(20_000))
    docs = documents(spark, [(1, text, "en"), (2, "a@b.c," * 3000, "en")])
    found = {r.doc_id: r.spans.split(",") for r in pii.find(docs).collect()}
    assert found[1] == base(text) and len(found[1]) > 5_000
    assert found[2] == base("a@b.c," * 3000)
    masked, at = [], 0
    for kind, start, stop in (s.split(":") for s in found[1]):
        if int(start) >= at:
            masked += [text[at : int(start)], f"[{kind.upper()}]"]
        at = max(at, int(stop))
    result = {r.doc_id: r.text for r in pii.mask_documents(docs).collect()}
    assert result[1] == "".join([*masked, text[at:]])
    assert result[2] == "[EMAIL]," * 3000


def test_overlapping_spans_are_masked_once(spark):
    text = "ab" * 1500
    spans = [(0, 0, 3), (2, 1, 2050), (5, 2, 7), (2050, 4, 2051), (2999, 3, 3000)]
    rows = spark.createDataFrame([(text, spans), (text, [])], "t string, s array<struct<start:bigint,kind:int,stop:bigint>>")
    masked = [r[0] for r in rows.select(pii.masked(F.col("t"), F.col("s"))).collect()]
    assert masked == ["[EMAIL][ID]" + text[2051:2999] + "[PHONE]", text]


def test_patterns_left_of_a_place_do_not_depend_on_pages(spark):
    long = "w" * 900 + "1234" * 300 + "v" * 70
    texts = [("x " * i + form) * 3 for i in (0, 505, 511, 512) for form in ("a bb (", f"a {long}", f"{long}\n\t" + " " * 1100 + "b ", "é 😀 c:")]
    rows = spark.createDataFrame([(n, t, len(t)) for n, t in enumerate(texts)], "n int, t string, at bigint")
    instance = F.array(F.struct(F.col("at").alias("start"), (F.col("at") + 1).alias("stop"), F.lit(1).cast("bigint").alias("instance")))
    found = rows.select("n", pii._in_context(F.concat("t", F.lit("7")), instance)[0]["patterns"]).collect()

    def word(text):
        return re.sub("[0-9]+", "0", text.lower())[-64:]

    for n, patterns in found:
        left = re.sub(r"(?<!\S)[\"'(<\[]\Z", "", texts[n])
        *first, last = re.findall(r"\S+", left)
        wanted = [f"{word(first[-1])} {word(last)}" if first else "\n " + word(last)]
        if first and "\n" in re.search(r"(\s+)\S+\s*\Z", left)[1] and "\n" not in re.search(r"\s*\Z", left)[0]:
            wanted.append("\n " + word(last))
        assert patterns == wanted, n


def test_tokens_outside_of_spans(spark):
    tokens, spans = [(0, 5), (7, 9), (12, 20), (30, 31)], [(1, 0, 2), (9, 1, 12), (10, 2, 11), (15, 1, 40), (16, 0, 17)]
    schema = "t array<struct<start:bigint,stop:bigint,instance:bigint>>, s array<struct<start:bigint,kind:int,stop:bigint>>"
    data = [([(a, b, a) for a, b in tokens], s) for s in (spans, spans[1:], spans[1:3], [])]
    left = spark.createDataFrame(data, schema).select(pii._outside(F.col("t"), F.col("s"))).collect()
    wanted = [[t for t in tokens if not any(a < t[1] and t[0] < b for a, _, b in s)] for _, s in data]
    assert [[(m.start, m.stop) for m in r[0]] for r in left] == wanted
