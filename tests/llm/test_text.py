import os
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from memloom.llm import bpe, canon, leak, pii, spam

HAVE = os.path.exists(os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken"))
ODD = [None, "", " ", "a", "Hello world, it's 2024!", "naïve façade ßẞ İı", "日本語 テキスト", "🙂👩‍👩‍👧", "x" * 600, " " * 300, "a\n\n\n  b\t\tc ", "1234567890" * 40, "é combining", "  wide　spaces line", "\x00\x01 control \x7f", "don't we'll I'M they'RE", "=====----->>>>", "the " * 2000, "漢字仮名交" * 9000, " " * 100_001, "Qk1aPz" * 5000]


@pytest.mark.skipif(not HAVE, reason="no vocabulary here")
@pytest.mark.parametrize("head", [bpe.HEAD, 3])
def test_bpe_equals_the_public_tokenizer_and_decodes(spark, monkeypatch, head):
    import base64

    import tiktoken

    monkeypatch.setattr(bpe, "HEAD", head)
    with open(os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=bpe.PATTERN.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(4, ODD[4], "clash", 2)], "doc_id long, text string, ids string, n int")
    table = bpe.vocabulary()
    out = bpe.encode(df, table)
    rows = out.select("doc_id", "ids", bpe.decode(F.col("ids"), table).alias("back")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[r["doc_id"]] or ""
        assert r["ids"] == (known.encode_ordinary(text) if text else []) and r["back"] == text
    assert bpe.encode(df.limit(0), table).count() == 0


@pytest.mark.skipif(not HAVE, reason="no vocabulary here")
def test_no_plan_of_the_encoding_prints_a_literal_again_and_again(spark):
    table = bpe.vocabulary()
    df = spark.createDataFrame([(i, f"word{i} " * 3) for i in range(4000)], "doc_id long, text string")
    out = bpe.encode(df, table)
    fold = df.select(bpe.encode_word(F.col("text"), bpe._literal(table, "int")))
    before = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 30))
    try:
        assert len(out._jdf.queryExecution().executedPlan().toString()) < 50_000
        assert len(fold._jdf.queryExecution().optimizedPlan().toString()) < 2_500_000  # the ranks once: 1.1 MB
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", before)


def _words(t):
    return re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower())


@pytest.mark.parametrize("small", [True, False])
def test_leaks_equal_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(leak, "BROADCAST_ROWS", 0)
    item = [f"Wört{i % 23}-{i}" for i in range(40)]
    other = ["again"] * 30
    items = [(1, " ".join(item), "x"), (2, " ".join(other), "x"), (3, "too short to leak", "x"), (4, None, None), (5, "", None)]
    docs = [(1, "Before " + ", ".join(item[3:15]).upper() + " after", "y"), (2, " ".join(item[3:14]), "y"), (3, None, None), (4, "", None), (5, " ".join(item[5:10] + ["cut"] + item[10:16]), "y"), (6, "x " + " ".join(item) + " " + "again " * 12, "y"), (7, "again " * 11, "y"), (1, "Before " + ", ".join(item[3:15]).upper() + " after", "y"), (8, "again " * 5000, "y"), (9, "x", None)]
    want = set()
    for d, t, _ in docs:
        for i, s, _ in items:
            w, x = _words(t or ""), _words(s or "")
            if {tuple(w[k : k + 12]) for k in range(len(w) - 11)} & {tuple(x[k : k + 12]) for k in range(len(x) - 11)}:
                want.add((d, i))
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = [(r["doc_id"], r["item_id"]) for r in leak.leaks(d, i).collect()]
    assert sorted(got) == sorted(want) and (1, 1) in want and (3, 1) not in want
    assert leak.leaks(d.limit(0), i).count() == 0 and leak.leaks(d, i.limit(0)).count() == 0


def test_canonical_values(spark):
    names = spark.createDataFrame([("marble-passport", "x"), ("copper-bridge", "x"), ("copper-parcel-north", "x"), ("golden-factory", None)], "slug string, alias string")
    aliases = spark.createDataFrame([("MAPA", "MARBLE-PASSPORT"), ("quicksand", "copper_bridge"), (None, "golden-factory"), ("lost", "nowhere")], "alias string, canonical string")
    cases = {
        "marble-passport": "marble-passport", "Passport Marble": "marble-passport", "mapa": "marble-passport", "marbel  pasport": "marble-passport", "MarblePassport": "marble-passport", "márble pässp0rt": "marble-passport",
        "proj-copper-bridge": "copper-bridge", "Quicksand (old name)": "copper-bridge", "copperbridge": "copper-bridge", "copper-parcel-no": "copper-parcel-north", "the golden factory repo": "golden-factory",
        "golden-bridge": "unmatched", "marble waffle": "unmatched", "2024": "unmatched", "???": "unmatched", "lost": "unmatched", "tbd": "unmatched", "x" * 3000: "unmatched",
    }
    rows = [(k, v, "clash") for k, v in enumerate([*cases, None, "", " \t ", "mapa"])]
    df = spark.createDataFrame(rows, "memory_id long, project string, canonical string").unionByName(spark.createDataFrame(rows[:1], "memory_id long, project string, canonical string"))
    got = {r["memory_id"]: r["canonical"] for r in canon.canonical_rows(df, names, aliases).collect()}
    assert got == {**{k: v for k, v in enumerate(cases.values())}, len(cases) + 3: "marble-passport"}
    assert canon.canonical_rows(df.limit(0), names, aliases).count() == 0
    assert {r["canonical"] for r in canon.canonical_rows(df, names.limit(0), aliases).collect()} == {"unmatched"}


def test_slips_in_every_word_still_match(spark):
    second = "lantern passport bridge parcel factory".split()
    names = [(f"{a}-{b}",) for a in "harbor marble copper golden silver".split() for b in second]
    slips = {"hrabor lantern": "harbor-lantern", "harbour lantern": "harbor-lantern", "lantern harbor": "harbor-lantern", "mrable psasport": "marble-passport", "copepr brigde": "copper-bridge"}
    df = spark.createDataFrame(list(enumerate(slips)), "memory_id long, project string")
    refs = canon.references(spark.createDataFrame(names, "slug string"), spark.createDataFrame([], "alias string, canonical string"), "slug", "alias", "canonical")
    assert {r["value"]: r["canonical"] for r in canon.match(df, refs, "project").collect()} == slips


PEOPLE = [f"{a}{b} {c}{d}" for a in ("Elo", "Fia", "Bran", "Ulr") for b in ("kel", "ric", "nna") for c in ("Skav", "Oltr", "Zelm") for d in ("egger", "inski", "holt")]


def _pii_rows():
    rows = []
    for i, n in enumerate(PEOPLE):
        given, last = n.lower().split()
        mail = [f"{given}.{last}@mail.example.org", f"{given[0]}{last}@box.example", f"{last}_{given[0]} [at] box.example.com", f"{given} dot {last} at box dot test"][i % 4]
        rows.append((i, f"Please ask {n} about the town pump, or write to {mail} soon. The Boat Shed of Limstead stays open.", None, "x"))
        rows.append((1000 + i, f"The boat shed near Limstead opens early and the town pump of Velgate is late, ask again about the roof in {i} days.", "marble-passport", "x"))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame(_pii_rows(), "id long, body string, person string, kind string")
    weights, facts = pii.learn(df.select(F.col("body").alias("text")))
    return pii.Disclosure(weights, {r["term"]: r["fact"] for r in facts.collect()})


@pytest.mark.parametrize(("text", "kinds"), [
    ("Call +49 30 23125 626 now", {"phone"}), ("Call (571) 555-0189.", {"phone"}), ("try 020 7946 0891", {"phone"}), ("au 01 99 00 56 17 svp", {"phone"}), ("368 five five five oh one nine seven", {"phone"}), ("030/23125875", {"phone"}),
    ("SSN 903 78 8816 seen", {"id_number"}), ("906-44-3473", {"id_number"}), ("NI number QQ 10 91 64 C", {"id_number"}), ("n° de sécu 9 51 99 04 675 342", {"id_number"}), ("Steuer-ID 00 136 053 359", {"id_number"}), ("DNI 00141117T", {"id_number"}), ("passport no. X07958229", {"id_number"}), ("driving licence DUNR9176216Q1", {"id_number"}),
    ("at 89B Yele Street, Ulmford", {"address"}), ("au 205 bis, rue des Limes.", {"address"}), ("in der Lindenstraße 12 wohnt", {"address"}), ("en Calle Falor 121, 2º B.", {"address"}), ("153 WENDI LANE", {"address"}),
    ("a.b+c@d.example", {"email"}), ("<mailto:x_y@z.example.com>", {"email"}), ("fiakel48 at quillmail dot example dot org", {"email"}), ("u(at)inbox(dot)example", {"email"}),
    ("Part no. 950-52-8184 of the pump", set()), ("Order 8558 5084 54 came", set()), ("Coordinates 51.5155, -1.4653 put it", set()), ("retry@12 and @reader", set()), ("On 2023-03-11 at 17:30", set()), ("Thunder Passport and Saddle Passport share one", set()), ("lane 12 of the path", set()), ("Row 46 of 999 rows", set()),
    ("Dr. Skavinski came", {"name"}), ("B. Oltregger came", {"name"}), ("Brannna van Zelmholt came", {"name"}), ("ELOKEL SKAVEGGER came", {"name"}), ("Skavholt, Fiaric came", {"name"}), ("Skavholt came", set()), ("the Boat Shed of Limstead", set()), ("", set()), (None, set()),
])
def test_entity_kinds(model, text, kinds):
    assert {k for *_, k in pii.find(text, model)} == kinds


def test_redaction_keeps_the_rest(spark):
    rows = _pii_rows() + [(5000, None, None, None), (5001, "", "", ""), (5002, "word " * 30_000 + "Call (571) 555-0189.", "Elokel Skavegger", None), (None, "Call (571) 555-0189.", None, None)]
    df = spark.createDataFrame(rows, "id long, body string, person string, kind string")
    out = {r["id"]: r for r in pii.redact(df).collect()}
    assert out[0]["body"] == "Please ask [NAME] about the town pump, or write to [EMAIL] soon. The Boat Shed of Limstead stays open."
    assert out[1001]["body"] == rows[3][1] and out[5000]["body"] is None and out[5001]["body"] == "" and out[5002]["person"] == "[NAME]" and out[5002]["body"].endswith("word Call [PHONE].")
    found = {(r["id"], r["field"], r["kind"]) for r in pii.found_kinds(df).collect()}
    assert {(0, "body", "name"), (0, "body", "email"), (5002, "body", "phone"), (5002, "person", "name")} <= found and not [x for x in found if 1000 <= x[0] < 5000]
    assert pii.found_kinds(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_facts_joined_to_the_texts_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(_pii_rows()[:120] + [(7000, "Elokel Skavegger", "Fiaric Oltregger", "x"), (7001, "nothing", "", None)], "id long, body string, person string, kind string")
    want, clean = {tuple(r) for r in pii.found_kinds(df).collect()}, {tuple(r) for r in pii.redact(df).collect()}
    monkeypatch.setattr(pii, "MAX_FACTS", 0)
    assert {tuple(r) for r in pii.found_kinds(df).collect()} == want and {tuple(r) for r in pii.redact(df).collect()} == clean and (7000, "person", "name") in want


def test_names_show_without_any_address(spark):
    rows = [(i, f"Dr. {n} saw the town pump near Limstead, and the Boat Shed stays open late.", None, "x") for i, n in enumerate(PEOPLE)]
    rows += [(1000 + i, f"The boat shed near Limstead opens early; ask again about the roof in {i} days.", None, "x") for i in range(100)] + [(5000, "Yesterday Branna Skavholt came to the boat shed near Limstead.", None, None)]
    found = {(r["id"], r["kind"]) for r in pii.found_kinds(spark.createDataFrame(rows, "id long, body string, person string, kind string")).collect()}
    assert (5000, "name") in found and (0, "name") in found and not [x for x in found if 1000 <= x[0] < 2000]


def test_addresses_of_any_length():
    local, spoken = "a" * 400, " dot ".join(["part"] * 80)
    for text in (f"write to {local}@box.example now", f"to q@{'d' * 300}.example.org now", f"say {spoken} at box dot example please"):
        assert [m.group()[-1] != " " for m in pii._emails(text)] == [True]
    assert max(len(m.group()) for m in pii._emails(f"say {spoken} at box dot example please")) > 600


SENTENCES = ["The council of the town moved the old market hall over the weekend.", "Nobody has checked the lighthouse since the storm, so the path is closed.", "We simplified the plan because a late delivery made it slow.", "Visitors to the harbour find the boat shed past a narrow lane.", "It was the quiet clerk that opened the new archive for the choir."]

NOUNS = "council market lighthouse harbour clerk archive choir storm lane roof delivery visitor plan weekend path boat shed hall town pump mill pond bridge library school kiosk".split()


def test_spam(spark):
    prose = [" ".join(SENTENCES[(i + k) % 5] for k in range(4)) for i in range(5)]
    cases = {
        1: "cheap hotel " + "cheap hotel near me best cheap hotel buy cheap hotel " * 9,
        2: "\n".join(f'<a href="https://shop{i}.example/p/{i}">storage units town{i}</a>' for i in range(12)),
        3: " ".join(f"#tag_{i}" for i in range(30)),
        4: "Our Velgate dentist is the best Velgate dentist for Velgate dentist buyers. Find Velgate dentist, buy Velgate dentist, Velgate dentist online and more Velgate dentist. " * 4,
        5: "roofing leather price cotton dentist near discount vintage hotel online compact locksmith blue casino gift plumber retro tractors matte loan outdoor shoes wireless flats " * 3,
        6: "\n".join(f"{i}. buy locksmith\nhttps://www.site{i}.example/{i}\n" for i in range(9)),
    }
    clean = {
        20: "\n".join(f"2023-01-{i:02d}T01:02:03Z INFO worker flush done rows={i}81" for i in range(1, 20)), 21: "| stop | first |\n|---|---|\n" + "\n".join(f"| Town{i} | {i}:30 |" for i in range(20)),
        22: '{"key": [' + ", ".join(f'{{"id": {i}, "name": "x"}}' for i in range(30)) + "]}", 23: "def f(x):\n    return [y for y in x if y]\n" * 6, 24: SENTENCES[0] + " See https://www.page.example/a and #harbour. " + SENTENCES[1] + " " + SENTENCES[2],
        25: None, 26: "", 27: "   \n ", 28: "hotel", 29: "#tag", **{30 + i: t for i, t in enumerate(prose)}, 40: " ".join(f"The {a} of the {b} was not in the {c} when we came to it." for a, b, c in zip(NOUNS * 30, NOUNS[7:] * 40, NOUNS[3:] * 40)),
    }
    rows = [(k, v, "clash", 0) for k, v in [*cases.items(), *clean.items()]] + [(1, cases[1], "clash", 0), (None, cases[2], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, at int")
    got = [r["doc_id"] for r in spam.spam_texts(df).collect()]
    assert sorted(got) == sorted(cases)
    assert spam.spam_texts(df.limit(0)).count() == 0


def test_copies_of_a_stuffed_page_stay_spam(spark):
    page = "Our Velgate dentist is the best Velgate dentist for Velgate dentist buyers. Find the Velgate dentist, buy Velgate dentist, Velgate dentist online and more Velgate dentist. " * 4
    prose = [" ".join(f"The {a} of the {b} was not in the {c} when we came to it." for a, b, c in zip(NOUNS[k:] * 2, NOUNS[k + 3 :] * 2, NOUNS[k + 7 :] * 2)) for k in range(12)]
    rows = [(i, page if i % 2 else page.upper() + f" {i}") for i in range(40)] + [(100 + i, t) for i, t in enumerate(prose)]
    got = {r["doc_id"] for r in spam.spam_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(40))
