"""Surrogates, the Pitman-Yor model, the pipeline."""

import math
import re
import zlib
from collections import Counter

import pytest
import regex

import corpus_pipeline
from pyspark.sql import functions as F

from tidemill.llm import base, packing, pii, pitman_yor, queries

SF = "/root/testdata/sf0.001"


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


TEXTS = [
    "Write to Ann.Lee@Mail.example.com or ann.lee@mail.example.com, not to bob99@x.org.",
    "Call +1 (705) 555-1234 or 705-555-1234; server 10.20.30.240, not 999.1.1.1 or 1.2.3.4.5.",
    "Card 4111 1111 1111 1111 and 4111111111111111, order 4111111111111112.",
    'token = "0123456789abcdef0123456789abcdef01234567" and ssn 078-05-1120',
    "Mrs. Mary Poppins met Mr Poppins and Dr. House. Later Mary Smith came; Mr. Иван Петров, госпожа Анна Петрова.",
    "Nothing here but words, 12 numbers, 2024 and a/b@ c.",
    "",
    None,
]


@pytest.fixture(scope="module")
def replaced(spark):
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1), (None, TEXTS[1], None)], "doc_id long, text string, n_entities long").repartition(3)
    rows = pii.replace_personal_data(df, key="k").collect()
    assert len(rows) == len(TEXTS) + 2 and rows[0].__fields__ == ["doc_id", "text", "n_entities"]
    return rows


def test_surrogates_keep_type_format_and_coreference(replaced):
    by = {r.doc_id: r for r in replaced}
    a, b = re.findall(r"\S+@\S+\b", by[0].text)[:2]
    assert a.lower() == b.lower() != "ann.lee@mail.example.com" and re.fullmatch(r"[a-z]{3}\.[a-z]{3}@[a-z]{4}\.[a-z]{7}\.com", b)
    assert by[0].n_entities == 3 and "bob99" not in by[0].text
    p, q = re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", by[1].text)
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q) != "7055551234" and "+1 (" in by[1].text
    assert "10.20.30.240" not in by[1].text and "999.1.1.1" in by[1].text and "1.2.3.4.5" in by[1].text
    c, d = re.findall(r"4\d{3}(?: ?\d{4}){3}", by[2].text)[:2]
    assert c.replace(" ", "") == d and luhn(d) and d != "4111111111111111" and "4111111111111112" in by[2].text
    assert re.search(r'token = "[0-9a-f]{40}" and ssn \d{3}-\d{2}-\d{4}', by[3].text) and "0123456789abcdef" not in by[3].text and "078-05-1120" not in by[3].text


def test_names_keep_gender_script_and_identity(replaced):
    t = {r.doc_id: r for r in replaced}[4].text
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr (\w+) and Dr\. (\w+)\. Later (\w+) (\w+) came; Mr\. (\w+) (\w+), госпожа (\w+) (\w+)\.", t)
    assert m, t
    given, last, again, house, given2, smith, he, his, she, hers = m.groups()
    assert last == again and given == given2 and len({last, house, smith}) == 3
    assert re.fullmatch("[А-Яа-яЁё]+", he + his + she + hers) and re.search("(ов|ин)$", his) and re.search("(ова|ина)$", hers)
    assert re.search("(a|ina|elle)$", given) and "Poppins" not in t and "Петров" not in t


def test_whole_secrets_and_phones_of_all_forms(spark):
    long, jwt, number = "aB3" * 133 + "z", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV", "4111111111111112"
    phones = ["555 123 4567", "+15551234567", "+33 1 23 45 67 89", "+49 30 123456", "030-1234567", "01 23 45 67 89"]
    clean = [f"order {number} of", "see 1,234 567 8901 or 2024-05-06", "let token = request.headers.get now"]
    texts = [f"token = {long}.", f"token = {jwt} end", f"secret: {number}", *(f"Call {p} now" for p in phones), *clean]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.replace_personal_data(df, key="k").collect()}
    assert [got[i][1] for i in range(len(texts))] == [1] * (3 + len(phones)) + [0] * len(clean)
    assert [got[i][0] for i in range(3 + len(phones), len(texts))] == clean
    for i, old in enumerate(texts[: 3 + len(phones)]):
        assert re.sub("[A-Za-z]", "a", re.sub("[0-9]", "0", got[i][0])) == re.sub("[A-Za-z]", "a", re.sub("[0-9]", "0", old))
    assert got[0][0][8:-1] != long and long[-40:] not in got[0][0] and number not in got[2][0]
    assert not any(part in got[1][0] for part in jwt.split("."))
    assert not any(p in got[3 + i][0] for i, p in enumerate(phones))


def test_mentions_equal_those_of_another_engine(spark):
    """One pass of the pattern in Spark against the same pattern in another engine, over texts with and without marks of its own."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(10_000 + i, t) for i, t in enumerate(TEXTS)] + [(20_000, f"{pii._MARKS[0]}x {TEXTS[0]} {pii._MARKS[2]}{TEXTS[3]}"), (20_001, "a" + pii._MARKS[1])]
    pattern = regex.compile(pii.PATTERN)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in df.select("doc_id", pii.pieces(F.col("text")).alias("cut"), pii.mentions(pii.pieces(F.col("text"))).alias("found")).collect()}
    for i, text in docs:
        want = [(m[0], m[1] is not None) for m in pattern.finditer(text or "")]
        assert [(m.mention, m.behind) for m in got[i].found or []] == want, i
        if text is not None:
            assert got[i].cut[::3] == [text[a:b] for a, b in zip([0, *(m.end() for m in pattern.finditer(text))], [*(m.start() for m in pattern.finditer(text)), len(text)], strict=True)]


def test_further_forms(spark):
    kept = ["see pages 555-1234", "at 12:30:45 or std::vector", "order 4155551234", "Paris Berlin", "a 10:20:30:40"]
    texts = ["call 4155551234.", "Tel. 555-1234 x", "ring 020 7946 0958 now", "host fe80::1ff:fe23:4567:890a up", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "Alice Johnson met Bob Miller", "IBAN DE89370400440532013000 or GB29 NWBK 6016 1331 9268 19"]
    df = spark.createDataFrame(list(enumerate(texts + kept)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_personal_data(df, key="k").collect()}
    assert [got[i].n_entities for i in range(len(texts))] == [1, 1, 1, 1, 1, 2, 2]
    assert [got[len(texts) + i].text for i in range(len(kept))] == kept
    shape = lambda t: re.sub("[0-9a-f]", "0", t)
    assert all(shape(got[i].text) == shape(texts[i]) and got[i].text != texts[i] for i in range(5))
    first, second = re.search(r"IBAN (\w+) or ([\w ]+)", got[6].text).groups()
    for account, land in ((first, "DE"), (second.replace(" ", ""), "GB")):
        assert account[:2] == land and int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
    assert len(second) == len("GB29 NWBK 6016 1331 9268 19") and not re.search("Alice|Bob|Johnson|Miller", got[5].text)


def test_social_security_numbers_are_valid_and_cramped_formats_end(spark):
    units = [("ssn", f"{i:09d}") for i in range(300)] + [("ip", f"{a}.{b}.1.{c}") for a in range(1, 10) for b in range(1, 10) for c in range(1, 10)]
    units += [("email", f"{chr(97 + i)}@{chr(97 + j)}.org") for i in range(26) for j in range(26)]
    rows = pii.distinct_surrogates(spark.createDataFrame(units, "kind string, canon string"), "k").collect()
    assert len(rows) == len(set(units)) == len({(r.kind, r.surrogate) for r in rows})
    assert not {(r.kind, r.surrogate) for r in rows} & set(units)
    for r in rows:
        if r.kind == "ssn":
            assert re.fullmatch(r"(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}", r.surrogate)
        if r.kind == "ip":
            assert all(0 < int(x) < 256 for x in r.surrogate.split("."))


def test_grown_digits_are_shown(spark):
    df = spark.createDataFrame([("phone", "030-1234567", "0301234567", "030987654321")], "kind string, raw string, canon string, surrogate string")
    assert df.select(pii._rendered().alias("x")).first().x == "030-987654321"[:11] + "21"


def test_columns_of_any_name_stay(spark):
    names = ["cut", "mark", "filled", "__key", "__filled", "text_key", "at", "shown", "mention", "behind", "CUT_"]
    df = spark.createDataFrame([(1, TEXTS[0], *names), (2, "plain", *names)], f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names)}")
    got = pii.replace_personal_data(df, key="k")
    assert got.columns == [*df.columns, "n_entities"]
    rows = got.collect()
    assert all([r[n] for n in names] == names for r in rows) and {r.n_entities for r in rows} == {0, 3}


def test_one_row_of_each_group_stays_in_the_pipeline(spark):
    same, near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 2 + "end"
    other = "quite another text of some words that is like no other one in this table at all"
    rows = [(3, same, "a"), (3, other, "b"), (None, same, "c"), (2, near, "d"), (2, near, "e"), (None, None, "f"), (None, "", "g"), (7, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id string").withColumn("row", F.lit(1)).coalesce(1)
    got = corpus_pipeline.deduplicate(spark, base.stored(df), SF)
    assert got.columns == df.columns
    assert sorted(r.gone_id for r in got.collect()) in (["b", "d", "f", "g", "h"], ["b", "e", "f", "g", "h"])


def test_clean_and_repeated_rows(replaced):
    by = {r.doc_id: r for r in replaced}
    assert (by[5].text, by[5].n_entities, by[6].text, by[7].text, by[7].n_entities) == (TEXTS[5], 0, "", None, 0)
    assert len({r.text for r in replaced if r.doc_id == 0}) == 1 and by[None].text == by[1].text


def test_surrogates_are_distinct_and_never_real(spark):
    # sixty units of the hundred two-digit ones collide at first
    units = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(60)] + [("given_f", "mary")], "kind string, canon string")
    rows = pii.distinct_surrogates(units, "k").collect()
    ssn = [r for r in rows if r.kind == "ssn"]
    assert len(rows) == 61 and len({r.surrogate for r in ssn}) == 60 and not {r.surrogate for r in ssn} & {r.canon for r in ssn}


def test_surrogates_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pii.replace_personal_data(docs, key="k").collect()
    old = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(old) and all((r.text != old[r.doc_id]) == (r.n_entities > 0) for r in rows)
    found = re.compile(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) 555-\d{4}|[0-9a-f]{40}")
    real = {x for t in old.values() for x in found.findall(t)}
    assert real and not any(x in r.text for r in rows for x in real)
    assert pii.replace_personal_data(docs.limit(0), key="k").count() == 0


def test_long_words_do_not_stall(spark, edge_docs):
    assert pii.replace_personal_data(edge_docs, key="k").where("n_entities > 0").count() == 0


def test_base_scores_equal_brute_force_and_the_model_is_better(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, ws in docs.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = queries.op6_pitman_yor(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    mean = lambda f: sum(getattr(r, f) for r in rows if r.held_out) / sum(r.n_tokens for r in rows if r.held_out)
    assert mean("score") > mean("base_score") + 0.2


def test_language_model_edges(spark, edge_docs):
    got = pitman_yor.score(edge_docs, pitman_yor.fit(edge_docs)).collect()
    assert len(got) == edge_docs.count() and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1 and by[10].n_tokens == 3
    none = pitman_yor.fit(edge_docs, F.lit(False))
    assert {r.score for r in pitman_yor.score(edge_docs, none).collect()} == {0.0}
    empty = edge_docs.limit(0)
    assert pitman_yor.score(empty, pitman_yor.fit(empty)).count() == 0


def test_pipeline_stage_by_stage(spark):
    docs = base.table(spark, SF, "documents")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in base.table(spark, SF, "labels").collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = base.stored(stage(spark, docs, SF))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4]
    kept = {r.doc_id: r.text for r in docs.collect()}
    bad = [i for i in kept if labels.get(i) == 0]
    assert len(kept) > 0.5 * sizes[0] and len(bad) <= 2
    packed = packing.pack(docs, queries.byte_bpe_spec()).collect()
    assert {r.doc_id for r in packed} == set(kept) and corpus_pipeline.run(spark, SF).count() == len(packed)


def test_pipeline_stages_on_edge_rows(spark, edge_docs):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert stage(spark, docs, SF).count() > 0 or name == "quality_rules", name
