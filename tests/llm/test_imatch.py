import hashlib

from samples import TEXTS, documents, empty_documents, rows_of, with_clashes

from reviewmill.llm import imatch


def order(row):
    key, text, _ = row
    return (key is not None, key or 0, hashlib.blake2b((text or "").encode(), digest_size=8).digest())


def test_edited_texts_against_brute_force(spark):
    for block_docs in (4_000, 3):
        found = imatch.fingerprint_documents(documents(spark), block_docs=block_docs).collect()
        wanted = []
        rows = sorted(TEXTS, key=order)
        for (key, text, _), (_, after, _) in zip(rows, rows[1:] + rows[:1]):
            text, after = text or "", after or ""
            edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
            wanted.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest()))
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr) == sorted(wanted, key=repr)
        prints = {}
        for r in found:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            prints.setdefault(next(t or "" for k, t, _ in TEXTS if k == r.doc_id), set()).add(r.fingerprint)
        assert all(len(p) == 1 for p in prints.values())


def test_blocks_do_not_change_the_result(spark):
    one = rows_of(imatch.fingerprint_documents(documents(spark)))
    assert rows_of(imatch.fingerprint_documents(with_clashes(documents(spark)), block_docs=2)) == one


def test_one_row_and_no_row(spark):
    (row,) = imatch.fingerprint_documents(documents(spark, [(5, "abcdefgh", None)])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
    assert imatch.fingerprint_documents(empty_documents(spark)).count() == 0


def test_lexicon_is_the_band(spark):
    rows = [(i, f"common term{i} pair{i // 2}", "en") for i in range(40)]
    assert imatch.lexicon(documents(spark, rows), band=(2 / 40, 0.5)) == sorted(f"pair{i}" for i in range(20))


def test_likeness_tells_edits_from_other_texts(spark):
    words = [f"w{i}" for i in range(4000)]
    terms = {w for w in words[:300]}
    subsets = imatch.Subsets(sorted(words), imatch.RATES, imatch.SUBSETS_PER_RATE, 1)
    own, edited = subsets.fingerprint(terms), subsets.fingerprint(terms - set(words[:40]) | set(words[300:340]))
    other = subsets.fingerprint(set(words[1000:1300]))
    assert imatch.likeness(own, own) == 1.0
    assert imatch.likeness(own, edited) > 0.3 > 0.2 > imatch.likeness(own, other)
    assert imatch.likeness("=a", "=a") == 1.0 and imatch.likeness("=a", own) == 0.0
