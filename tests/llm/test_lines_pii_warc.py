import random
import re

import pytest
from pyspark.sql import functions as F

from duofix.llm import lines, pii, warc


def brute_lines(docs, min_sites):
    sites, first = {}, {}
    for d, t, s in docs:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                k = x.strip(" ")
                sites.setdefault(k, set()).update({s} - {None})
                if d is not None:
                    first[k] = min(first.get(k, d), d)
    gone = lambda d, x: x.strip(" ") and len(sites[x.strip(" ")]) >= min_sites and d != first.get(x.strip(" "))
    out = []
    for d, t, _ in docs:
        if t is None:
            out.append((d, 0, 0, None))
        else:
            p = t.split("\n")
            kept = [x for x in p if not gone(d, x)]
            out.append((d, len(p), len(p) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [2, 8])
def test_lines_equal_brute_force(spark, min_sites):
    r = random.Random(1)
    docs = []
    for i in range(200):
        p = [r.choice([f"own {i} {k}", f"common {r.randint(0, 12)}", f" common {r.randint(0, 3)} ", "", "  ", "é" * r.randint(1, 3)]) for k in range(r.randint(0, 8))]
        docs.append((i, "\n".join(p), r.choice([*(f"s{x}" for x in range(11)), None])))
    docs += [(900, None, "s1"), (901, "", "s1"), (None, "common 1\nfree", "s2"), docs[5], (902, "common 2\n" * 3000 + "end", "s3")]
    df = spark.createDataFrame([(*x, 1, "h") for x in docs], "doc_id long, text string, source string, key int, h string").repartition(3)
    got = lines.line_dedup(df, min_sites=min_sites)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted([(x.doc_id, x.n_lines, x.n_removed, x.text) for x in got.collect()], key=str) == brute_lines(docs, min_sites)
    assert lines.line_dedup(df.limit(0)).count() == 0
    kept = lines.strip(df, min_sites=min_sites)
    assert kept.columns == df.columns and {None, 900, 901} <= {x.doc_id for x in kept.collect()}


def test_estimates_far_from_the_threshold_agree_with_counts(spark):
    df = spark.range(60_000).select((F.col("id") % 60).alias("h"), (F.col("id") % 997 % (F.col("id") % 60 * 12 + 1)).cast("string").alias("site"), F.col("id").alias("doc"))
    want = {x.h for x in df.groupBy("h").agg(F.countDistinct("site").alias("n")).where("n >= 300").collect()}
    assert {x.h for x in lines.spread(df, 300, 0.1).collect()} == want


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


TEXTS = [
    "Write to Jo.Doe7@Mail3.example.com or jo.doe7@mail3.example.com, not to été.5@mail.example.org!!",
    "Call +1 (523) 555-1055 or +1 523 555 1055.",
    "Card 4111111111111111 and 4111 1111 1111 1111, not 4111111111111112.",
    "From 10.20.30.40, 300.1.1.1 is none and 1.2.3.4.5 is none. 255.255.255.255!!",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### API_KEY: AbC123xyzAbC123xyz9',
    "Mrs. Anna Smith met Mr. John Smith. Later Mrs. Smith and FRAU x left. Г-жа Анна Иванова здесь.",
    "Nothing here at all.",
    "",
    None,
]


def test_surrogates_keep_kind_format_and_identity(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 0)], "doc_id long, text string, own_0 int")
    rows = pii.pseudonymise(df, key="k").collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) + 1
    assert [got[i].text for i in (6, 7, 8)] == TEXTS[6:] and [got[i].n_entities for i in (6, 7, 8)] == [0, 0, 0]
    mail = re.fullmatch(r"Write to (\S+@\S+\.com) or (\S+@\S+\.com), not to (\S+@\S+\.org)!!", got[0].text)
    assert mail and mail[1].lower() == mail[2] and mail[1] != mail[2] and "doe" not in got[0].text.lower() and "é" not in mail[3] and got[0].n_entities == 3
    assert re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}\d@[A-Z][a-z]{3}\d\.[a-z]{7}\.com", mail[1])
    phone = re.fullmatch(r"Call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4})\.", got[1].text)
    assert phone and re.sub(r"\D", "", phone[1]) == re.sub(r"\D", "", phone[2]) != "15235551055"
    card = re.fullmatch(r"Card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}), not 4111111111111112\.", got[2].text)
    assert card and luhn(card[1]) and card[1] == card[2].replace(" ", "") != "4111111111111111" and card[1][0] == "4"
    ip = re.fullmatch(r"From (\S+), 300\.1\.1\.1 is none and 1\.2\.3\.4\.5 is none\. (\S+)!!", got[3].text)
    assert ip and all(0 <= int(x) <= 255 for k in (1, 2) for x in ip[k].split(".")) and ip[1] != "10.20.30.40"
    secret = re.fullmatch(r'token = "([0-9a-f]{40})"### API_KEY: (\w{19})', got[4].text)
    assert secret and secret[1] != TEXTS[4][9:49] and secret[2] != "AbC123xyzAbC123xyz9"
    name = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+)\. Later Mrs\. (\w+) and FRAU x left\. Г-жа ([а-я]+) ([а-я]+) здесь\.", got[5].text, re.IGNORECASE)
    assert name and name[2] == name[4] == name[5] != "Smith" and name[1] != name[3]
    assert name[1] in pii.GIVEN["latin", "f"].split() and name[3] in pii.GIVEN["latin", "m"].split() and got[5].n_entities == 4
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, key="other").collect()}
    assert all(other[i] != got[i].text for i in range(6))


def test_surrogates_stay_distinct_and_new(spark):
    """Few digits to draw from, so that draws collide."""
    phones = [f"+1 ({i:02d}) 555-000" for i in range(60)]
    texts = [f"ring +1 (1{i:02d}) 555-{j:03d}0 now" for i in range(20) for j in range(30)] + [f"Mr. {chr(65 + i % 26)}{chr(97 + i // 26)}x Doe" for i in range(120)]
    df = spark.createDataFrame(list(enumerate([*phones, *texts])), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, key="k").collect()}
    new = [got[i] for i in range(60, 60 + 600 + 120)]
    assert len(set(new)) == len(new) and not set(new) & set(texts)


def plain_entities(text):
    """Detection by plain Python for the kinds that it can tell: (kind, value) in order."""
    kinds = [("email", r"(?<![\w.%+-])[^\W_][\w.%+-]*@(?:[\w-]+\.)+[^\W\d_]{2,24}"), ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), ("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)")]
    out = [(m.start(), k, m[0]) for k, p in kinds for m in re.finditer(p, text) if k != "ip" or all(int(x) < 256 and x == str(int(x)) for x in m[0].split("."))]
    return [x[1:] for x in sorted(out)]


def test_surrogates_equal_a_plain_detector_and_replacer(spark):
    """Every plain entity is replaced by one of its kind, the same for the same one, another for another, and nothing else changes."""
    r = random.Random(5)
    words = ["alpha", "beta", "x@", "12", "3.4", "@home", "10-11-2012", "v1.2", "né", "!!"]
    things = [f"{a}{i}@{h}.org" for i in range(9) for a in ("Ann.", "bo-") for h in ("site", "Mail.ex")] + [f"{i}23-4{i}-678{i}" for i in range(10)] + [f"10.{i}.3.25{i % 6}" for i in range(12)] + ["300.1.1.1", "1.2.3.4.5"]
    docs = [(i, " ".join(r.choice(things if r.random() < 0.3 else words) for _ in range(r.randint(0, 60)))) for i in range(150)]
    got = {x.doc_id: x for x in pii.pseudonymise(spark.createDataFrame(docs, "doc_id long, text string"), key="k").collect()}
    put, back = {}, {}
    for i, text in docs:
        old, new = text.split(" "), got[i].text.split(" ")
        assert len(old) == len(new) and got[i].n_entities == len(plain_entities(text))
        for a, b in zip(old, new, strict=True):
            found = plain_entities(a)
            if not found:
                assert a == b
                continue
            (kind, _), = found
            assert [k for k, _ in plain_entities(b)] == [kind] and a.lower() != b.lower()
            assert put.setdefault(a.lower(), b.lower()) == b.lower() and back.setdefault(b.lower(), a.lower()) == a.lower()


def test_kinds_that_need_more_than_digits(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVP"
    texts = [
        f"see {jwt}, done",
        "password: swordfish and Password = 'Tr0ub4dor'.",
        "call 030 1234567 or 555-123-4567 now",
        "host 2001:db8::ff00:42:8329 and std::vector",
        "IBAN DE89 3704 0044 0532 0130 00, not DE89 3704 0044 0532 0130 01.",
        "ssn 123-45-6789",
        "Mr. Jean-Luc Picard spoke. Dr. Beverly Crusher and Picard left; Jean-Luc Picard's ship, Picardy.",
        "a" * 100 + "@example.com",
        "Amex 3782 822463 10005",
    ]
    got = [x.text for x in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").orderBy("doc_id").collect()]
    assert re.fullmatch(r"see [\w.-]+, done", got[0]) and not any(x in got[0] for x in jwt.split("."))
    assert re.fullmatch(r"password: [a-z]{9} and Password = '[A-Z][a-z]\d[a-z]{2}\d[a-z]{3}'\.", got[1]) and "swordfish" not in got[1]
    assert re.fullmatch(r"call \d{3} \d{7} or \d{3}-\d{3}-\d{4} now", got[2]) and got[2] != texts[2] and "1234567" not in got[2] and "555-123" not in got[2]
    assert re.fullmatch(r"host [0-9a-f:]+ and std::vector", got[3]) and "8329" not in got[3]
    iban = re.fullmatch(r"IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d), not DE89 3704 0044 0532 0130 01\.", got[4])
    bare = iban[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 and bare != "DE89370400440532013000"
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", got[5]) and got[5] != texts[5]
    name = re.fullmatch(r"Mr\. (\w+-\w+) (\w+) spoke\. Dr\. (\w+) (\w+) and (\w+) left; (\w+-\w+) (\w+)'s ship, Picardy\.", got[6])
    assert name and name[2] == name[5] == name[7] and name[1] == name[6] and "Picard " not in got[6] and "Luc" not in got[6]
    assert re.fullmatch(r"[a-z]{100}@[a-z]{7}\.com", got[7]) and got[7] != texts[7]
    assert re.fullmatch(r"Amex \d{4} \d{6} \d{5}", got[8]) and luhn(got[8][5:]) and got[8] != texts[8]


def test_more_entities_than_their_form_has_room_for(spark):
    """All 676 addresses of the form x@y.co, so that none of that form is free."""
    docs = [(i, f"{chr(97 + i % 26)}@{chr(97 + i // 26)}.co") for i in range(676)]
    got = [x.text for x in pii.pseudonymise(spark.createDataFrame(docs, "doc_id long, text string"), key="k").collect()]
    assert len({*got, *(t for _, t in docs)}) == 2 * 676 and all(re.fullmatch(r"[a-z]+@[a-z]\.co", x) for x in got)


def test_surrogates_with_a_column_of_the_name_of_the_count(spark):
    got = pii.pseudonymise(spark.createDataFrame([(1, "mail a@b.org", 3)], "doc_id long, text string, N_Entities int"), key="k")
    assert got.columns[2:] == ["N_Entities", "n_entities_0"] and got.first()[2:] == (3, 1)


def test_surrogates_of_an_empty_table(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "text string"), key="k").count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(0, TEXTS[0])], "doc_id long, text string")
    plan = pii.pseudonymise(df, key="k")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://www.Ex.com:80", "ex.com/"),
        ("https://ex.com/a/?b=2&a=1&utm_x=3#top", "ex.com/a?a=1&b=2"),
        ("http://u:p@ex.com:8080/A?ref=x", "ex.com:8080/A"),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want


def test_header_names_that_differ_by_case_are_joined(spark):
    recs = [(1, "a.com/x", 1, "response", "e", None, {"Set-Cookie": "a=1", "set-cookie": "b=2", "X": None, "x": "9"}, 1), (2, "a.com/x", 2, "revisit", "e", None, {"Date": "d", "DATE": "c"}, 1)]
    got = warc.resolve_revisits(spark.createDataFrame(recs, SCHEMA)).first()
    assert got.headers == {"set-cookie": "a=1, b=2", "x": "9", "date": "c, d"} and got.status == "resolved"


def test_lines_with_columns_of_the_names_of_the_statistics(spark):
    got = lines.line_dedup(spark.createDataFrame([(1, "a\nb", "s", 7, 8)], "doc_id long, text string, source string, n_lines int, N_REMOVED int"))
    assert got.columns[3:] == ["n_lines", "N_REMOVED", "n_lines_0", "n_removed_0"] and got.first()[3:] == (7, 8, 2, 0)


SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, part int"


@pytest.mark.parametrize("per_cut", [50_000, 3])
def test_revisits_equal_brute_force(spark, per_cut):
    r = random.Random(8)
    recs = []
    for i in range(400):
        url = r.choice(["http://a.com/x", "https://www.a.com/x/", "http://b.org/?q=1", "http://c.net/" + str(r.randint(0, 40))])
        etag = r.choice([None, '"1"', 'W/"1"', '"2"'])
        recs.append((i, url, r.randint(0, 60), r.choice(["response", "revisit", "revisit"]), etag, r.choice([None, "m1", "m2"]), r.choice([None, {"ETag": etag or "", "X": str(i), "content-length": "9"}, {"DATE": str(i)}]), 1))
    recs += [(900, None, 1, "revisit", None, None, None, 1), (901, "http://a.com/x", None, "revisit", None, None, None, 1), (902, "http://a.com/x", None, "response", None, None, None, 1), (None, "http://a.com/x", 5, "revisit", None, None, None, 1), (903, "http://a.com/x", 5, "other", None, None, None, 1)]
    canon = {"http://a.com/x": "a.com/x", "https://www.a.com/x/": "a.com/x", "http://b.org/?q=1": "b.org/?q=1"}
    name = lambda u: canon.get(u, u and u[7:])
    low = lambda m: {k.lower(): v for k, v in (m or {}).items()}
    want = {}
    for i, u, ts, kind, tag, lm, h, _ in recs:
        if kind != "revisit":
            continue
        if None in (i, u, ts):
            want[i] = (None, "incomplete", low(h))
            continue
        before = [x for x in recs if x[3] == "response" and x[2] is not None and name(x[1]) == name(u) and (x[2], x[0]) < (ts, i)]
        if not before:
            want[i] = (None, "no_earlier", low(h))
            continue
        t = max(before, key=lambda x: (x[2], x[0]))
        bare = lambda x: x.removeprefix("W/")
        s = ("resolved" if bare(tag) == bare(t[4]) else "mismatch") if tag and t[4] else ("resolved" if lm == t[5] else "mismatch") if lm and t[5] else "no_validator"
        merged = low(t[6]) | {k: v for k, v in low(h).items() if k in warc.PERMITTED}
        want[i] = (t[0], s, merged) if s == "resolved" else (None, s, low(h))
    df = spark.createDataFrame(recs, SCHEMA).repartition(3)
    got = warc.resolve_revisits(df, rows_per_cut=per_cut).collect()
    assert {x.record_id: (x.target_id, x.status, x.headers) for x in got} == want and len(got) == len(want)
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_strip_keeps_what_is_left_of_a_document_however_little(spark):
    line = "a passage that stands on many sites " * 5
    docs = [(i, line, f"s{i}") for i in range(10)] + [(10, f"{line}\nown", "s1"), (11, f"{line}\n \n", "s2"), (12, " \n", "s3"), (13, "", "s4"), (14, None, "s5")]
    got = {r.doc_id: r.text for r in lines.strip(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == {0: line, 10: "own", 12: " \n", 13: "", 14: None}


def test_a_secret_is_replaced_to_its_end(spark):
    long, late = "aB3_" * 100, "q" * 300 + "7" + "z" * 50
    df = spark.createDataFrame([(1, f"token={long} end"), (2, f"token={late} end")], "doc_id long, text string")
    for r in pii.pseudonymise(df, key="k").collect():
        old = long if r.doc_id == 1 else late
        new = r.text.removeprefix("token=").removesuffix(" end")
        assert r.n_entities == 1 and len(new) == len(old)
        assert all(old[k : k + 16] != new[k : k + 16] for k in range(0, len(old) - 16, 16))
