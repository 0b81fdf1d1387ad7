from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pixelloom.llm import pii

TEXTS = {
    1: "Mail Jane.Doe+x@mail.example.org or jane.doe+x@MAIL.example.org, call +1 (743) 555-3824 or 743-555-3824.",
    2: "Card 4994 2260 2090 0891 and 4994226020900891, ssn 123-45-6789, ip 10.20.30.40.",
    3: 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and password: hunter2hunter',
    4: "Mary Jones met John Jones. JONES left; Jones came back. Mary too.",
    5: "Анна Каренина и Иван Петров. Каренина ушла.",
    6: "no entities here, 12 or 1234 or v1.2.3",
    7: "erschzü.50@mail6.example.com!! 233.233.171.252!! X",
}


@pytest.fixture(scope="module")
def replaced(spark):
    rows = [*TEXTS.items(), (8, None), (9, ""), (1, TEXTS[1]), (None, "call 743-555-3824 now"), (10, "call (743) 555-3824 now")]
    d = spark.createDataFrame([(i, t, 5, "m") for i, t in rows], "doc_id long, text string, n_entities int, map string")
    out = pii.replace_pii(d).collect()
    assert len(out) == len(rows)
    return out


def text(out, i):
    return next(r["text"] for r in out if r["doc_id"] == i)


def test_nothing_private_stays(replaced):
    whole = " ".join(r["text"] or "" for r in replaced).lower()
    for secret in ("jane.doe", "743", "4994", "0891", "123-45", "10.20.30", "24be64", "hunter2", "jones", "mary", "john", "анна", "каренина", "петров", "erschz", "233.233"):
        assert secret not in whole


def test_formats_stay(replaced):
    assert re.fullmatch(r"Mail \w+\.\w+\+\w@mx\d+\.example\.\w+ or \w+\.\w+\+\w@mx\d+\.example\.\w+, call \+1 \([2-9]\d\d\) \d{3}-\d{4} or [2-9]\d\d-\d{3}-\d{4}\.", text(replaced, 1))
    m = re.fullmatch(r"Card (4\d{3} \d{4} \d{4} \d{4}) and (4\d{15}), ssn \d{3}-\d\d-\d{4}, ip \d+\.\d+\.\d+\.\d+\.", text(replaced, 2))
    assert m and m[1].replace(" ", "") == m[2]
    digits = [int(c) for c in m[2]][::-1]
    assert (sum(digits[0::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert re.fullmatch(r'token = "[0-9a-f]{40}" and password: [a-z]+\d[a-z]+', text(replaced, 3))


def test_coreference_gender_and_script(replaced):
    m = re.fullmatch(r"(\w+na) (\w+r) met (\w+n) (\w+)\. (\w+) left; (\w+) came back\. (\w+) too\.", text(replaced, 4))
    assert m and m[2] == m[4] == m[6] and m[5] == m[2].upper() and m[1] == m[7] and m[1] != m[3]
    m = re.fullmatch(r"([А-Я][а-я]+на) ([А-Я][а-я]+ва) и ([А-Я][а-я]+р) ([А-Я][а-я]+в)\. ([А-Я][а-я]+ва) ушла\.", text(replaced, 5))
    assert m and m[2] == m[5]
    phone = text(replaced, 10).split("call ")[1]
    assert re.sub(r"\D", "", phone) == re.sub(r"\D", "", text(replaced, None)), "the same number in other documents, also without an id"


def test_rest_stays(replaced):
    assert text(replaced, 6) == TEXTS[6] and text(replaced, 8) is None and text(replaced, 9) == ""
    assert {r["n_entities"] for r in replaced} == {5} and {r["map"] for r in replaced} == {"m"}, "columns of the input pass through"
    assert {r["doc_id"]: r["n_entities_1"] for r in replaced}[2] == 4


def test_another_key_gives_other_surrogates(spark):
    d = spark.createDataFrame([(1, TEXTS[2])], "doc_id long, text string")
    a, b, c = (pii.replace_pii(d, secret_key=k).first()["text"] for k in ("one", "one", "two"))
    assert a == b != c


def test_collisions_are_resolved(spark):
    """Given names have few surrogates that begin alike; three-digit-poor ids collide by force of numbers."""
    rows = [(i, f"{i % 900 + 100:03d}-{i // 900:02d}-0000") for i in range(900)]
    canons = spark.createDataFrame([(f"ssn|{t.replace('-', '')}",) for _, t in rows], "canon string").distinct()
    tight = canons.select(F.concat(F.lit("ip|"), F.substring("canon", 5, 3), F.lit(".1.1.1")).alias("canon")).distinct()
    for c in (canons, tight):
        got = pii.assign(c, "k").collect()
        assert len(got) == c.count() == len({r["surrogate"] for r in got})
    real = {r["canon"].split("|")[1] for r in canons.collect()}
    assert not real & {r["surrogate"] for r in pii.assign(canons, "k").collect()}


def test_forced_collisions(spark, monkeypatch):
    def coarse(canons, key):
        n = F.pmod(F.hash("canon", "attempt"), F.lit(40))
        return canons.select("canon", "attempt", F.concat(F.lit("v"), n.cast("string")).alias("surrogate"))

    monkeypatch.setattr(pii, "with_surrogate", coarse)
    c = spark.createDataFrame([(f"secret|s{i}",) for i in range(25)], "canon string")
    got = pii.assign(c, "k").collect()
    assert len({r["surrogate"] for r in got}) == 25 and len({r["canon"] for r in got}) == 25


def test_awkward_rows(docs, none):
    out = pii.replace_pii(docs)
    assert out.columns == [*docs.columns, "n_entities"] and out.count() == docs.count()
    assert pii.replace_pii(none).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    from pixelloom.llm.queries import op1_pii_surrogates

    plan = op1_pii_surrogates(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


FORMS = {
    1: ("Ring +491701234567 or 06 12 34 56 78 or +33 6 12 34 56 78 today.", r"Ring \+49\d{10} or 0\d \d\d \d\d \d\d \d\d or \+33 \d \d\d \d\d \d\d \d\d today\.", ("1701234567", "12 34 56 78")),
    2: ("IBAN GB29 NWBK 6016 1331 9268 19, or DE89370400440532013000.", r"IBAN GB\d\d NWBK \d{4} \d{4} \d{4} \d\d, or DE\d{20}\.", ("6016 1331", "370400440532013000")),
    3: ("From 2001:0db8:85a3:0000:0000:8a2e:0370:7334 and fe80::1ff:fe23:4567:890a.", r"From [0-9a-f]{4}(:[0-9a-f]{4}){7} and [0-9a-f]{4}::[0-9a-f]{3}:[0-9a-f]{4}:[0-9a-f]{4}:[0-9a-f]{4}\.", ("85a3", "4567:890a")),
    4: ("My name is Zoltan Kovacs. Kovacs said so.", r"My name is (\w+) (\w+r)\. \2 said so\.", ("Zoltan", "Kovacs")),
    5: ("Ich heiße Özgür Yılmaz, je m'appelle Amélie Dupont.", r"Ich heiße \w+ \w+, je m'appelle \w+ \w+\.", ("Özgür", "Yılmaz", "Amélie", "Dupont")),
    6: ("Пишите ольга.п@mail.example.com скорее.", r"Пишите [а-я]{5}\.[а-я]@mx\d+\.example\.\w+ скорее\.", ("ольга",)),
    7: ("At 12:30:45 the ratio 3:4 held; std::vector, IN 2024 ALL THE 1234 WORDS.", None, ()),
}


def test_more_forms(spark):
    d = spark.createDataFrame([(i, f[0]) for i, f in FORMS.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(d).collect()}
    for i, (before, pattern, gone) in FORMS.items():
        if pattern is None:
            assert got[i] == before
        else:
            assert re.fullmatch(pattern, got[i]), (i, got[i])
            assert not any(x in got[i] for x in gone), (i, got[i])


def test_more_names_than_short_surrogates(spark):
    """70,000 Cyrillic surnames, more than there are four-syllable ones."""
    letters = "абвгдежзик"
    canons = spark.range(70_000).select(F.concat(F.lit("surname|ц"), F.translate(F.col("id").cast("string"), "0123456789", letters), F.lit("ов")).alias("canon"))
    got = pii.assign(canons, "k")
    assert got.count() == 70_000 == got.select("surrogate").distinct().count()
    assert got.where(~F.col("surrogate").rlike("^[а-я]+в$")).count() == 0


SURNAMES = {
    1: ("James McDonald came. McDonald left, MCDONALD too; mcdonald stays, McDonalds and Donald stay.", r"\w+n (\w+)\. (\w+) left, (\w+) too; mcdonald stays, McDonalds and Donald stay\."),
    2: ("Mary Smith-Jones spoke. Then Smith-Jones sat.", None), 3: ("Dr. O'Neil rang; O'Neil's car, O’Neil is another.", None), 4: ("Анна Римская-Корсакова пела. Римская-Корсакова ушла.", None),
    5: ("Γιώργος Παπαδόπουλος ήρθε. Ο Παπαδόπουλος έφυγε.", None), 6: ("Mr. Baker met BAKER. X-Api-Key: abcdef123 and O'baker@mail.example.org", None), 7: ("John Jones's dog. Jones' cat, Jones’s mouse.", None),
}


def test_surnames_are_found_again_in_any_spelling(spark):
    d = spark.createDataFrame([(i, f[0]) for i, f in SURNAMES.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replace_pii(d).collect()}
    t = {i: r["text"] for i, r in got.items()}
    m = re.fullmatch(r"(\w+n) (\w+r) came\. (\w+) left, (\w+) too; mcdonald stays, McDonalds and Donald stay\.", t[1])
    assert m and m[2] == m[3] and m[4] == m[2].upper() and got[1]["n_entities"] == 4
    m = re.fullmatch(r"(\w+na) (\w+r) spoke\. Then (\w+r) sat\.", t[2])
    assert m and m[2] == m[3]
    m = re.fullmatch(r"Dr\. (\w+r) rang; (\w+r)'s car, O’Neil is another\.", t[3])
    assert m and m[1] == m[2]
    m = re.fullmatch(r"(\w+на) (\w+ва) пела\. (\w+ва) ушла\.", t[4])
    assert m and m[2] == m[3]
    m = re.fullmatch(r"(\w+ς) (\w+ς) ήρθε\. Ο (\w+ς) έφυγε\.", t[5])
    assert m and m[2] == m[3]
    m = re.fullmatch(r"Mr\. (\w+r) met (\w+R)\. X-Api-Key: (\w{9}) and O'(\w{5})@mx\d+\.example\.\w+", t[6])
    assert m and m[2] == m[1].upper() and m[3] != "abcdef123" and m[4] != "baker"
    m = re.fullmatch(r"\w+n (\w+)'s dog\. (\w+)' cat, (\w+)’s mouse\.", t[7])
    assert m and m[1] == m[2] == m[3] != "Jones"


def test_short_mails_never_run_out(spark):
    """60,000 mails of one letter: more than a host of three digits tells apart."""
    canons = spark.range(60_000).select(F.concat(F.lit("email|a@h"), F.col("id").cast("string"), F.lit(".example")).alias("canon"))
    got = pii.assign(canons, "k")
    assert got.count() == 60_000 == got.select("surrogate").distinct().count()


def test_documents_equal_a_plain_replacer(spark, sf_dir):
    """Every text scanned by hand: entities by the pattern, then capitalised words between them by the document's surnames."""
    regex = pytest.importorskip("regex")
    find, word = regex.compile(pii.PATTERN), regex.compile(pii.WORD)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = [(10_000 + i, f[0]) for i, f in SURNAMES.items()] + [(30_000 + i, f[0]) for i, f in FORMS.items()] + [(20_000 + i, x) for i, x in TEXTS.items()]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).repartition(4)
    rows = docs.collect()
    mentions = sorted({m for r in rows for m in find.findall(r["text"] or "")} | {m for r in rows for m in word.findall(r["text"] or "")})
    known = spark.createDataFrame([(m,) for m in mentions], "x string").withColumn("kind", pii.kind_of(F.col("x")))
    known = {r["x"]: r for r in known.withColumns({"canon": pii.canonical(F.col("x"), F.col("kind")), "name": pii.canonical(F.col("x"), F.lit("surname"))}).collect()}
    of_doc = {r["doc_id"]: {known[m]["canon"] for m in find.findall(r["text"] or "")} for r in rows}
    canons = sorted(set().union(*of_doc.values()))
    made = {r["canon"]: r["surrogate"] for r in pii.assign(spark.createDataFrame([(c,) for c in canons], "canon string"), "pixelloom").collect()}
    pairs = [(m, known[m]["kind"], made[known[m]["canon"]]) for m in mentions if known[m]["canon"] in made] + [(m, "surname", made[known[m]["name"]]) for m in mentions if known[m]["name"] in made]
    said = spark.createDataFrame(pairs, "x string, kind string, to string").distinct()
    said = {(r["x"], r["kind"]): r["w"] for r in said.withColumn("w", pii.written(F.col("x"), F.col("kind"), F.col("to"))).collect()}
    want = {}
    for r in rows:
        t, own = r["text"], of_doc[r["doc_id"]]
        if t is None:
            want[r["doc_id"]] = (None, 0)
            continue
        out, at, n = [], 0, 0

        def between(a, b, t=t, own=own, out=out):
            gap, k, found = t[a:b], 0, 0
            for m in word.finditer(gap):
                out.append(gap[k : m.start()])
                hit = known[m[0]]["name"] in own
                out.append(said[m[0], "surname"] if hit else m[0])
                found += hit
                k = m.end()
            out.append(gap[k:])
            return found

        for m in find.finditer(t):
            n += between(at, m.start()) + 1
            out.append(said[m[0], known[m[0]]["kind"]])
            at = m.end()
        n += between(at, len(t))
        want[r["doc_id"]] = ("".join(out), n)
    got = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.replace_pii(docs).collect()}
    assert got == want and sum(n for _, n in want.values()) > 50
