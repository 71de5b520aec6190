"""Quality, chat, secrets, private data, neighbours, near copies, language model and the pipeline against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import chat, class_lm, components, hnsw, near_copies, private, quality, queries, secret_scan
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


# --- quality ---


def brute_quality(t, least=8):
    w = WORD.findall(t)
    n = len(w)
    win = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    repeated = {j for i in range(n - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    most = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            most[i], most[j] = max(most[i], k), max(most[j], k)
    covered = {j for i in range(n) if most[i] >= least for j in range(i, i + most[i])}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), len(covered), max(most, default=0)


def measured(texts):
    rows = quality.measure(pa.nulls(len(texts), pa.int64()), pa.array(texts, pa.large_string()), quality.Rules()).to_pylist()
    return [tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")) for r in rows]


def test_repeats_against_all_pairs():
    r = random.Random(2)
    texts = ["", "\n", "a"] + ["".join(r.choice("abé"[: r.randint(1, 3)]) + r.choice([" ", " ", "\n", "  # "]) for _ in range(r.randint(0, 70))) for _ in range(300)]
    assert measured(texts) == [brute_quality(t) for t in texts]


def test_op3(spark, docs):
    short = {d: t for d, t in docs.items() if len(t) < 3000}
    for r in queries.op3_quality_rules(spark, str(DATA)).collect():
        if r.doc_id in short:
            b = brute_quality(short[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered, r.longest_repeat) == b
            failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
            assert r.base_failed == failed and r.kept == (not failed and b[5] <= 0.2 * b[0] and b[6] <= 50)


def test_long_repeat_goes(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    passage = " ".join(word() for _ in range(60))
    clean = " ".join(word() for _ in range(2000))
    rows = [(1, clean), (2, f"{passage} {clean} {passage}"), (3, f"{passage} {clean}")]
    got = {x.doc_id: (x.base_failed, x.kept, x.longest_repeat) for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][:2] == (False, True) and got[3][:2] == (False, True)
    assert got[2] == (False, False, 60)


def test_quality_odd_rows(odd, none):
    got = sorted((r.doc_id, r.n_words, r.kept) for r in quality.judge(odd).collect())
    assert [x for x in got if x[0] == 5] == [(5, 1, False)] * 2 and (7, 0, False) in got and (40, 18, True) in got
    stays = quality.accepted(odd)
    assert stays.schema == odd.schema and {r.doc_id for r in stays.collect()} == {x[0] for x in got if x[2]}
    assert quality.judge(none).count() == quality.accepted(none).count() == 0


# --- chat ---


def conversation_digests(rows):
    out = {}
    for conv, turns in rows.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def test_op4(spark):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows[r.conv_id].append((r.role or "", r.text or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    rows[-1] = [("user", said), ("assistant", said)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op4_chat_formatting(spark, str(DATA)).collect()}
    assert got == conversation_digests(rows)


def test_op4_against_sql(spark, duck):
    df = queries.op4_chat_formatting(spark, str(DATA))
    rel = duck.sql(queries.ORACLES["op4_chat_formatting"])
    kinds = {"bigint": "BIGINT", "string": "VARCHAR"}
    assert {c: kinds[k] for c, k in df.dtypes} == dict(zip(rel.columns, map(str, rel.types)))
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_chat_odd_rows(spark, path):
    hostile = ["<|im_start|>", "<\\|x", "<\\\\|", "a\\nb", "", None, "<|im_end|>\n", "<", "<<|endoftext|>", "x" * 9000, "日本 \r\n"]
    rows, want = [], defaultdict(list)
    r = random.Random(1)
    for conv in range(30):
        for turn in range(r.randint(1, 6)):
            role, text = r.choice(["user", "assistant", "assistant", "a\nb", None, "s\\n"]), r.choice(hostile)
            rows.append((conv, turn, role, text, "extra", 1))
            want[conv].append((role or "", text or ""))
    rows += [(None, 1, "user", "n", "", 0), (None, 0, "assistant", "m", "", 0)]
    want[None] = [("assistant", "m"), ("user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, ids int").repartition(5)
    out = chat.assemble(df, path)
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.digest(out, path).collect()}
    assert got == conversation_digests(want)
    t = chat.Template(path)
    for x in out.collect():
        ids, marks = np.array(x.ids), [i for i in x.ids if i >= t.start]
        assert marks == [t.start, t.end] * len(want[x.conv_id]) and len(ids) == len(x.loss_mask)
        assert chat.parse(x.formatted) == want[x.conv_id]
    twice = spark.createDataFrame([(1, 0, "user", "a")] * 2, "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.assemble(twice, path), path).first().n_turns == 2
    assert chat.assemble(twice.limit(0), path).count() == 0


# --- secrets ---

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = (("assign", ASSIGN, 6, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0))


def brute_spans(t):
    out = [(m.start(), k, m.end(), kind) for k, (kind, p, n, g) in enumerate(BASE) for m in p.finditer(t) if len(m[g]) >= n]
    return ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(out))


def test_op7(spark, docs):
    for r in queries.op7_secret_scans(spark, str(DATA)).collect():
        want = brute_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("format")) == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))


def test_base_spans_of_odd_texts():
    texts = ['TOKEN = "abcdef"', "api_key:abcde api_key:abcdefg", "toKen=x tOken'=  'abcdef123", "paſſword=abcdef", "AKIAAKIA" + "Z" * 20, "0" * 23 + "g" + "f" * 24, "secret=secret=aaaaaa", "é" * 3 + "password=AKIA" + "B" * 16]
    for t in texts:
        assert ",".join(f"{k}:{a}:{z}" for a, z, k, _ in secret_scan.base_spans(t)) == brute_spans(t)


def test_inferred_formats(spark):
    r = random.Random(9)
    key = lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    known = [f"word {key()} more password={hexed(18)} and {hexed(40)} end" for _ in range(150)]
    fresh = hexed(18)
    texts = [*known, f"ordinary text then {fresh} follows", "internationalisation of words like counterrevolutionaries2", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.spans for x in secret_scan.scan(df).collect()}
    assert [(s.kind, s.value) for s in got[150]] == [("format", fresh)]
    assert got[151] == got[152] == got[153] == []
    assert secret_scan.redact(texts[150], [s.asDict() for s in got[150]]) == "ordinary text then " + "*" * 18 + " follows"


def test_formats_short_dotted_and_around_base_spans(spark):
    r = random.Random(10)
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    makers = [lambda: hexed(12), lambda: f"hd{hexed(8)}.{hexed(10)}.{hexed(10)}", lambda: f"sk_live_{hexed(30)}"]
    for make in makers:
        fresh = make()
        texts = [*(f"plain words before password={make()} and after" for _ in range(150)), f"ordinary text then {fresh}."]
        got = {x.doc_id: x.spans for x in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert [s.value for s in got[150] if s.kind == "format"] == [fresh]
        assert [s.value for s in got[150] if s.kind == "hex"] == re.findall("[0-9a-f]{24,}", fresh)


def test_merging_keeps_counts():
    values = [f"key-{i:03d}" for i in range(60)] + [f"key-{i:05d}" for i in range(60)]
    a = secret_scan.infer(values)
    assert a.score("key-999") >= a.least and a.score("key-98765") >= a.least > max(a.score("key-abc"), a.score("zzzzzzzz"))


def test_candidates_and_pairs_against_loops():
    r = random.Random(17)
    credential = set(secret_scan.LETTERS)
    for _ in range(300):
        t = "".join(r.choice(["token=", "abc123", ".", " ", "é", "AKIA" + "Z9" * 8, "0f" * 12, "x", "7", "=", "-", "secret: '"]) for _ in range(r.randint(0, 12)))
        spans = secret_scan.base_spans(t)
        want = []
        for m in re.finditer("[" + re.escape(secret_scan.LETTERS) + "]+", t):
            whole = m[0].strip(".")
            pieces = [(m.start() + m[0].find(whole), whole)] + [(m.start() + p.start(), p[0]) for p in re.finditer("[^.]+", m[0])] * ("." in whole)
            for a, s in pieces:
                if len(m[0]) >= 6 and len(s) >= 6 and re.search("[0-9]", s) and re.search("[A-Za-z]", s) and not any(x <= a and a + len(s) <= y for x, y, *_ in spans):
                    want.append((a, a + len(s), s))
        assert secret_scan.candidates(t, spans) == want, t
        b = np.frombuffer(t.encode(), np.uint8)
        got = secret_scan.char_pairs(b).reshape(secret_scan.N, secret_scan.N)
        code = [secret_scan.LETTERS.index(chr(c)) + 1 if chr(c) in credential else 0 for c in b]
        count = Counter(zip(code, code[1:]))
        assert all(got[x] == n for x, n in count.items() if x != (0, 0)) and got.sum() == sum(n for x, n in count.items() if x != (0, 0))


def test_dense_spans_take_linear_time():
    for n in (2_000, 40_000):
        t = "".join(f"token = abc{i:05d}x{i % 97} and k{i}.v{i * 7919 % 99991} " for i in range(n))
        at = time.process_time()
        spans = secret_scan.base_spans(t)
        assert len(spans) >= n and len(secret_scan.candidates(t, spans)) >= n
        assert time.process_time() - at < 60e-6 * n + 0.5
    run = "z1" * 1_500_000
    at = time.process_time()
    assert len(secret_scan.candidates(run, secret_scan.base_spans(run))) == 1 and time.process_time() - at < 3


def planted_formats(r):
    """Makers of credentials, and of runs of letters and digits that are none."""
    pick = lambda of, n: "".join(r.choice(of) for _ in range(n))
    low, up, dig, hexed = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    good = {
        "hex of 20": lambda: pick(hexed, 20), "hex of 24 to 64": lambda: pick(hexed, r.randint(24, 64)), "prefixed": lambda: "ghx_" + pick(low + up + dig, 36), "three parts": lambda: ".".join(pick(low + up + dig + "_-", n) for n in (20, 30, 27)),
        "groups": lambda: "-".join(pick(up + dig, 5) for _ in range(4)), "uuid": lambda: "-".join(pick(hexed, n) for n in (8, 4, 4, 4, 12)),
    }
    bad = [
        lambda: f"20{r.randint(10, 29)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}a{r.randint(0, 999999):06d}f{r.randint(0, 99999):05d}", lambda: pick(low, r.randint(5, 9)) + f".{r.randint(10, 99)}", lambda: f"mail{r.randint(0, 9)}.example.com",
        lambda: f"chapter-{r.randint(1, 40)}.{r.randint(1, 9)}", lambda: pick(low, 10) + str(r.randint(1, 9)), lambda: f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}-rc{r.randint(1, 9)}", lambda: f"2026-11-{r.randint(10, 28)}T{r.randint(10, 23)}",
    ]
    return good, bad


def test_precision_and_recall_of_formats():
    r = random.Random(31)
    good, bad = planted_formats(r)
    words = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 10))) for _ in range(20_000))
    background = secret_scan.Background(secret_scan.char_pairs(np.frombuffer(words.encode(), np.uint8)))
    rules = secret_scan.Rules()
    verdict = lambda m, v: (lambda x: x[0] >= m.least and x[1] >= background.score(v) + rules.margin)(m.likelihood(v))
    for name, make in good.items():
        m = secret_scan.infer([make() for _ in range(300)], rules)
        hits = sum(verdict(m, make()) for _ in range(400))
        wrong = sum(verdict(m, f()) for f in bad for _ in range(200))
        assert hits >= 0.9 * 400 and wrong <= 0.01 * 200 * len(bad), (name, hits, wrong, m.states)
        assert m.states >= 4
    few = secret_scan.infer([make() for make in good.values()], rules)
    assert few is None, "a handful of values is no format"


def test_secret_odd_rows(odd, none):
    out = secret_scan.digest(secret_scan.scan(odd))
    assert out.count() == odd.count() and out.filter("spans <> ''").count() == 0
    assert secret_scan.scan(none).count() == 0


# --- private data ---

KEY = b"a key of the tests"


def test_surrogates_are_distinct_and_keep_their_form():
    r = random.Random(3)
    kinds = {
        "phone": lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(0, 9999):04d}", "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: (lambda d: d + private.luhn(d))("4" + "".join(str(r.randint(0, 9)) for _ in range(14))), "email": lambda: f"{r.choice('abcd')}{r.choice('xyz')}.{r.randint(0, 99)}@mail{r.randint(0, 9)}.example.com",
        "ssn": lambda: f"{r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", "name": lambda: "Mrs " + r.choice(["Anna", "Eva", "Olga", "Inga"]) + " " + r.choice(["Müller", "Smith", "Иванова", "Lee"]),
    }
    for kind, make in kinds.items():
        values = {make() for _ in range(800)}
        new = {v: private.surrogate(kind, v, KEY) for v in values}
        assert len(set(new.values())) == len(values) and all(a != b and len(a) == len(b) for a, b in new.items())
        for a, b in new.items():
            assert [c.isdigit() for c in a] == [c.isdigit() for c in b] and [c.isupper() for c in a] == [c.isupper() for c in b]
            assert private.entities(f"x {b} y") and private.entities(f"x {a} y")[0][2] == kind
            if kind == "card":
                assert private.luhn(b[:-1]) == b[-1] and b[0] == a[0]
            if kind == "name":
                assert a.split()[0] == b.split()[0] and a[-1] == b[-1]
    assert private.surrogate("email", "A.b@Mail.Example.com", KEY).lower() == private.surrogate("email", "a.b@mail.example.com", KEY)
    assert private.surrogate("phone", "+1 (988) 555-2485", KEY).replace("(", "").replace(") ", "-") == private.surrogate("phone", "+1 988-555-2485", KEY)
    assert private.surrogate("email", "a@b.com", b"one") != private.surrogate("email", "a@b.com", b"two")


def test_small_cycles_are_permutations():
    for n in (2, 3, 10, 97, 256):
        p = private.Permutation(b"k", "t", n)
        assert sorted(p.forward(x) for x in range(n)) == list(range(n)) and all(p.back(p.forward(x)) == x for x in range(n))
        seen, x = set(), 0
        while x not in seen:
            seen.add(x)
            x = p.next(x)
        assert len(seen) == n


def test_private_text(spark, odd, none):
    rows = [(1, "call +1 (988) 555-2485 4524132264652876 or bob.42@mail8.example.com at 70.123.182.155 now 42.", 0), (2, None, 0), (3, "bob.42@mail8.example.com again", 0), (4, "v 4.0. and 1.2.3.4.5 12345", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    new = {r.doc_id: r.text for r in private.replaced(df, KEY).collect()}
    for v in ("(988)", "4524132264652876", "bob.42", "70.123.182.155"):
        assert v not in new[1]
    assert new[1].startswith("call +1 (") and new[1].endswith(" now 42.") and len(new[1]) == len(rows[0][1]) and new[2] is None and new[4] == rows[3][1]
    assert re.search(r"or (\S+) at", new[1])[1] == new[3].split()[0]
    scanned = {r.doc_id: r for r in private.scan(df, KEY).collect()}
    assert [e.kind for e in scanned[1].entities] == ["phone", "card", "email", "ip"] and scanned[2].text == ""
    values = spark.createDataFrame([("ip", f"1.2.{i // 256}.{i % 256}") for i in range(2000)], "kind string, value string")
    assert private.collisions(values, KEY).count() == 0
    same = private.replaced(odd, KEY)
    assert same.schema == odd.schema and sorted(map(str, same.collect())) == sorted(map(str, odd.collect()))
    assert private.replaced(none, KEY).count() == private.scan(none, KEY).count() == 0


def test_op9(spark, docs):
    left = 0
    for r in queries.op9_pii_surrogates(spark, str(DATA)).collect():
        t = docs[r.doc_id]
        assert len(t) == len(r.text)
        at = 0
        for e in r.entities:
            assert t[at : e.start] == r.text[at : e.start] and r.text[e.start : e.end] == e.surrogate != t[e.start : e.end]
            at = e.end
            left += 1
        assert t[at:] == r.text[at:]
        for v in re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\S+@\S+\.com", t):
            assert v not in r.text
    assert left


def test_entities_written_two_ways_stay_apart():
    replace = private.Replacer(KEY)
    new, found = replace("at 1.2.3.4 or 01.2.3.4 or 10.20.30.255 or 010.2.3.4 not 1.2.3.256")
    values = [x[3] for x in found]
    assert len(found) == 4 and len(set(values)) == 4 and [[len(o) for o in v.split(".")] for v in values] == [[1, 1, 1, 1], [2, 1, 1, 1], [2, 2, 2, 3], [3, 1, 1, 1]]
    assert values[1][0] == values[3][0] == "0" and all(int(o) < 256 for v in values for o in v.split(".")) and new.endswith("not 1.2.3.256")


def test_every_format_is_a_bijection():
    """All strings of a few small formats: no two meet, none stays, and what is drawn is of the format."""
    formats = {
        "phone": [f"+49 {a:02d}{b:02d} {c:02d}{d:02d}" for a in range(0, 100, 9) for b in range(0, 100, 7) for c in range(0, 100, 11) for d in (0, 10, 20)] + [f"{a}55-555-{b:04d}" for a in range(10) for b in range(0, 9999, 50)],
        "card": [f"4000 0000 0000 {x:04d}" for x in range(3000)], "iban": [f"DE{c:02d}12345678901{x}" for c in range(2, 99) for x in range(30)],
        "birth": [f"{d:02d}.{m:02d}.19{y}" for d in range(1, 29) for m in range(1, 13) for y in range(50, 60)] + [f"{m}/{d}/2001" for d in range(1, 29) for m in range(1, 13)] + [f"1985-{m:02d}-{d:02d}" for d in range(1, 29) for m in range(1, 13)],
        "name": ["Mr " + x for x in ["Lane", "Road", "Prof", "Anna", "Emma", "Weiß", "Ñi", "ǅa", "ǆa", "İz", "Smith", "SMITH", "Sm-Ith", "Élan"] + [a + b + "no" for a in "BCDFGH" for b in "aeiouy"]],
        "address": [f"{n} {w} {s}" for n in range(1, 60) for w in ("Rue", "Ave", "Lame", "Anna", "Oak Tree") for s in ("Road", "Lane")] + [f"Haupt{s} {n}" for s in ("straße", "gasse") for n in range(1, 60)],
    }
    for kind, values in formats.items():
        values = list(dict.fromkeys(values))
        new = [private.surrogate(kind, v, KEY) for v in values]
        assert len(set(new)) == len(values) and all(len(a) == len(b) for a, b in zip(values, new)), kind
        if kind not in ("name",):
            assert all(a != b for a, b in zip(values, new)), kind
        for a, b in zip(values, new):
            assert [c.isupper() for c in a] == [c.isupper() for c in b] and [c.isdigit() for c in a] == [c.isdigit() for c in b]
            if kind == "iban":
                assert (private.iban_check(a[:2], a[4:]) == a[2:4]) == (private.iban_check(b[:2], b[4:]) == b[2:4])
            if kind == "birth":
                assert private.date_sort(a) == private.date_sort(b)


def test_mentions_gender_births_and_addresses():
    replace = private.Replacer(KEY)
    text = "Mrs Anna Smith called. Anna Smith said so; Smith left. ANNA too. Smithson and annals stay. Peter Braun, born on 03.04.1971, lives at 12 Oak Tree Road; Hauptstraße 5b is empty, as is 7, rue de la Paix."
    new, found = replace(text)
    assert len(new) == len(text)
    for v in ("Anna", "Smith ", "Braun", "03.04.1971", "Oak", "Tree", "Haupt", "Paix"):
        assert v not in new.replace("Smithson", "")
    words = re.match(r"Mrs (\w+) (\w+) called\. (\w+) (\w+) said so; (\w+) left\.", new)
    assert words[1] == words[3] and words[2] == words[4] == words[5]
    assert private.SORTS[words[1].lower()] == "f" and "Smithson and annals stay" in new and "Road" in new and "straße" in new and "rue de la" in new
    assert {k for _, _, k, _ in found} == {"name", "birth", "address"}
    assert replace("Herr Ñi und Frau Weiß")[0].isascii() is False and len(replace("Herr Ñi und Frau Weiß")[0]) == len("Herr Ñi und Frau Weiß")


def brute_entities(t):
    """Naive: every span of a text that is an entity in itself, kinds in their order, earliest and longest first."""
    local = re.compile(r"[A-Za-z0-9_.+-]{0,63}[A-Za-z0-9_]")
    domain = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
    octet = lambda x: x.isascii() and x.isdigit() and len(x) < 4 and int(x) < 256
    taken, out = [False] * len(t), []

    def keep(kind, good):
        a = 0
        while a < len(t):
            hit = next((z for z in range(len(t), a, -1) if not any(taken[a:z]) and good(a, z)), None)
            if hit:
                out.append((a, hit, kind))
                taken[a:hit] = [True] * (hit - a)
            a = hit or a + 1

    def email(a, z):
        s = t[a:z]
        x, _, y = s.partition("@")
        return s.count("@") == 1 and local.fullmatch(x) and domain.fullmatch(y) and not (("\n" + t)[a] in private.LOCAL and len(x) < 64 and not (a and taken[a - 1])) and not re.match("[A-Za-z0-9]", (t + "\n")[z])

    def ip(a, z):
        p = t[a:z].split(".")
        return len(p) == 4 and all(map(octet, p)) and not re.match(r"[0-9.]", ("\n" + t)[a]) and not re.match(r"[0-9]|\.[0-9]", t[z:])

    def ssn(a, z):
        return re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", t[a:z]) and not re.match(r"[A-Za-z0-9_-]", ("\n" + t)[a]) and not re.match(r"[A-Za-z0-9_-]", (t + "\n")[z])

    keep("email", email)
    keep("ip", ip)
    keep("ssn", ssn)
    return sorted(out)


def test_entities_against_all_spans():
    r = random.Random(21)
    parts = ["a.b", "x@y.com", "@", "a@b", ".org", "1.2.3.4", "1.2.3", "300.1.1.1", "078-05-1120", "-", " ", ".", "é", "x_1@mail-1.example.de", "12", "+", "z" * 30, "99.88.77.66"]
    for _ in range(250):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 8)))
        assert [e for e in private.entities(t) if e[2] in ("email", "ip", "ssn")] == brute_entities(t), t


def test_private_texts_of_some_megabytes():
    """Long runs and dense entities take time in proportion to the length."""
    r = random.Random(5)
    makers = [
        lambda n: "x" * n + "@ and " + "y.z" * 9 + "@a.com", lambda n: "a@" * (n // 2), lambda n: "a@b." * (n // 4), lambda n: "Mr " + "X" * n, lambda n: "Mr Anna Smith " * (n // 14),
        lambda n: " ".join(f"{r.randint(100, 999)}-55-{r.randint(1000, 9999)}" for _ in range(n // 12)), lambda n: "1." * (n // 2), lambda n: "12 " * (n // 3), lambda n: "A-" * (n // 2), lambda n: "+1 (" * (n // 4),
    ]
    for make in makers:
        for n in (20_000, 2_000_000):
            t = make(n)
            at = time.process_time()
            private.entities(t)
            assert time.process_time() - at < 20e-6 * n + 0.5, (t[:20], n)


# --- neighbours ---


def test_op8_and_odd_vectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in rows}
    hit = total = 0
    got = defaultdict(dict)
    for r in queries.op8_nearest_neighbours(spark, str(DATA)).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
        a, b = x[r.query_id], x[r.vec_id]
        assert abs(r.score - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12
    assert set(got) == {i for i in x if i % 50 == 0}
    for q, found in got.items():
        best = sorted(((-(x[q] @ v) / (np.linalg.norm(x[q]) * np.linalg.norm(v)), i) for i, v in x.items() if i != q))[:5]
        hit, total = hit + len({i for _, i in best} & {i for i, _ in found.values()}), total + 5
    assert hit / total >= 0.95


def test_vectors_with_copies_and_gaps(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 300)] + [(900, [0.0, 1.0]), (901, None), (902, [0.0, 0.0]), (903, [float("nan"), 1.0]), (904, [1.0, None]), (905, [2.0, 0.0]), (None, [1.0, 1.0]), (906, [1e-200, 1e-200]), (907, [1.0, 0.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS score", "1 AS v")
    out = {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in hnsw.search(df, df.filter("vec_id in (0, 3, 900, 901, 902, 903, 907)")).collect()}
    assert [out[0, k] for k in range(1, 6)] == [(i, 1.0) for i in (1, 2, 3, 4, 5)]
    assert [out[3, k][0] for k in range(1, 6)] == [0, 1, 2, 4, 5]
    assert out[900, 1] == (906, round(2**-0.5, 9)) and {q for q, _ in out} == {0, 3, 900}
    assert hnsw.search(df.limit(0), df.limit(0)).count() == 0


def test_recall_over_shards(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(4000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    g = hnsw.Graph(shard=1000, beam=96)
    got = defaultdict(set)
    for row in hnsw.search(df, df.filter("vec_id % 100 = 0"), g=g).collect():
        got[row.query_id].add(row.vec_id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = [len(got[q] & set(np.argsort(-(u @ u[q]))[1:6].tolist())) for q in range(0, 4000, 100)]
    assert sum(hits) / (5 * len(hits)) >= 0.9
    index = hnsw.Index(u)
    assert len(index.levels) > 1 and all(links.shape[1] == 24 for _, links in index.levels)


def test_multiples_of_one_vector(spark):
    """Ties, and near ties, go by double precision, then by the smaller id."""
    r = np.random.default_rng(8)
    v = r.normal(size=24)
    x = {i: v * (i + 1) for i in range(400)} | {1000 + i: r.normal(size=24) for i in range(300)}
    df = spark.createDataFrame([(i, y.tolist()) for i, y in x.items()], "vec_id long, embedding array<double>")
    got = [(q.vec_id, q.score) for q in hnsw.search(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    exact = {i: float(np.dot(v, y) / (hnsw.norms(v[None])[0] * hnsw.norms(y[None])[0])) for i, y in x.items() if i}
    assert got == sorted(exact.items(), key=lambda h: (-h[1], h[0]))[:5]


@pytest.mark.parametrize("clusters", [3, 8, 40])
def test_recall_in_clusters_at_shipped_parameters(clusters):
    r = np.random.default_rng(clusters)
    x = (r.normal(size=(clusters, 64))[r.integers(0, clusters, 8192)] + 0.15 * r.normal(size=(8192, 64))).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    index = hnsw.Index(u)
    q = u[::100]
    got = index.search(q, 6)
    best = np.argsort(-(q @ u.T), axis=1)[:, :6]
    recall = np.mean([len(set(a) & set(b)) / 6 for a, b in zip(got.tolist(), best.tolist())])
    assert recall >= 0.95, recall


def test_graph_of_inserted_nodes():
    """Links are of a level's nodes, none twice or to itself; every node is met from the entry; the same rows give the same graph."""
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 65, 1500):
        x = r.normal(size=(n, 16)).astype(np.float32)
        u = x / np.linalg.norm(x, axis=1)[:, None]
        index = hnsw.Index(u)
        again = hnsw.Index(u)
        assert all((a[1] == b[1]).all() for a, b in zip(index.levels, again.levels))
        for row, links in index.levels:
            nodes = np.flatnonzero(row >= 0)
            for node in nodes:
                near = links[row[node]][links[row[node]] >= 0].tolist()
                assert len(near) == len(set(near)) and node not in near and set(near) <= set(nodes.tolist())
        if not n:
            continue
        links, met, open_ = index.levels[0][1], {index.entry}, [index.entry]
        while open_:
            for near in links[open_.pop()].tolist():
                if near >= 0 and near not in met:
                    met.add(near)
                    open_.append(near)
        assert len(met) >= 0.99 * n


# --- near copies ---


def brute_classes(docs, threshold=0.8):
    sets = {}
    for d, t in docs.items():
        w = WORD.findall(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    having = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            having[g].append(d)
    common = Counter()
    for ds in having.values():
        for i, a in enumerate(sorted(ds)):
            for b in sorted(ds)[:i]:
                common[b, a] += 1
    root = {d: d for d in docs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (a, b), c in common.items():
        if c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in docs}


def test_op2(spark, docs):
    got = {r.doc_id: r.class_id for r in queries.op2_minhash_near_dedup(spark, str(DATA)).collect()}
    assert got == brute_classes(docs)


def planted(seed=8, base=12, copies=30):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    out, shared = {}, " ".join(word() for _ in range(60))
    for b in range(base):
        text = [word() for _ in range(r.randint(80, 250))]
        for c in range(r.randint(1, copies)):
            t = list(text)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = word()
            out[len(out) * 7 % 10007] = (shared + " " if b % 3 == 0 else "") + " ".join(t)
    return out


def test_groups_of_near_copies(spark):
    texts = planted()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    want = brute_classes(texts)
    assert {r.doc_id: r.class_id for r in near_copies.classes(df).collect()} == want
    few = near_copies.Setup(split=24)  # large buckets are dealt to parts
    assert {r.doc_id: r.class_id for r in near_copies.classes(df, few).collect()} == want
    stays = near_copies.deduplicated(df)
    assert {r.doc_id for r in stays.collect()} == set(want.values())


def test_pairs_across_parts_of_a_large_bucket(spark):
    """Texts of one source share many words; only the two shortest are near copies, by what all share, and resemble no other."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(200)]
    texts = {d: " ".join(shared + [word() for _ in range(22 if d in (0, 300) else 150)]) for d in range(600)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.class_id for x in near_copies.classes(df, near_copies.Setup(split=1)).collect()}
    assert got == {d: 0 if d == 300 else d for d in texts}


def test_copies_that_repeat_a_line(spark):
    """How often a text repeats its shingles makes no difference to their sets, nor to which pairs are compared."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = {}
    for g in range(6):
        head, line = [word() for _ in range(70)], [word() for _ in range(30)]
        texts |= {10 * g + k: " ".join(head + line * n) for k, n in enumerate((1, 50, 400))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute_classes(texts)
    assert len(set(want.values())) == 6
    assert {x.doc_id: x.class_id for x in near_copies.classes(df).collect()} == want


def test_near_copies_odd_rows(spark, odd, none):
    got = {r.doc_id: (r.class_id, r.copy_of) for r in near_copies.classes(odd).collect()}
    assert got[12] == (11, 11) and got[7] == (7, 7) and got[3] == (3, 3) and len(got) == 13
    rows = odd.unionAll(odd.limit(1).selectExpr("cast(null as long)", "text", "kept", "length", "`a.b`"))
    stays = near_copies.deduplicated(rows)
    assert stays.schema.fieldNames() == odd.schema.fieldNames()
    ids = [r.doc_id for r in stays.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(set(got) - {12}) and ids.count(None) == 1
    assert near_copies.classes(none).count() == near_copies.deduplicated(none).count() == 0


def test_one_id_with_two_texts(spark):
    r = random.Random(13)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c = text(120), text(120), text(90)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b), (4, c), (4, c), (5, ""), (5, ""), (5, None), (6, " "), (7, b + " x y"), (7, text(50)), (None, a)]
    df = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, f1 string, `a.b` int").repartition(3)
    got = sorted((x.doc_id, x.class_id) for x in near_copies.classes(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 1), (7, 7)]
    stays = near_copies.deduplicated(df)
    assert stays.columns == df.columns
    texts = sorted((x.doc_id or 0, x.text or "") for x in stays.collect())
    assert texts == sorted([(1, a), (1, b), (4, c), (5, ""), (6, " "), (7, rows[11][1]), (0, a)])


def test_registers_estimate_probability_jaccard():
    r = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.9):
        n = 400
        a = r.integers(1, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[: int(n * share)], r.integers(1, 1 << 62, n - int(n * share)).astype(np.uint64)])
        weights = r.integers(1, 4, n)
        h = np.concatenate([np.repeat(a, weights), np.repeat(b, weights)])
        sig = near_copies.prob_min_hash(h, np.array([0, weights.sum(), 2 * weights.sum()]), 1024)
        wa, wb = dict(zip(a.tolist(), 1 + np.log(weights))), dict(zip(b.tolist(), 1 + np.log(weights)))
        keys = wa.keys() | wb.keys()
        exact = sum(1 / sum(max(wa.get(y, 0) / wa[x], wb.get(y, 0) / wb[x]) for y in keys) for x in wa.keys() & wb.keys())
        assert abs((sig[0] == sig[1]).mean() - exact) < 4 * math.sqrt(exact * (1 - exact) / 1024) + 0.005


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x.id: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in root}


# --- language model ---


def lm_words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [""]


def test_op6(spark, docs):
    counts = Counter()
    for d, t in docs.items():
        if zlib.crc32(str(d).encode()) % 10:
            counts.update(lm_words(t))
    n, v = sum(counts.values()), len(counts)
    rows = queries.op6_lm_scoring(spark, str(DATA)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = lm_words(docs[r.doc_id])
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and math.isfinite(r.score) and r.score < 0


def test_score_against_brute_force(spark, none):
    """Scores recounted from the texts with the model's classes; words beyond the head are where a plain count puts them."""
    r = random.Random(19)
    word = lambda: "".join(r.choice("aeiourstlmn") for _ in range(r.randint(1, 4))) + r.choice(["", "", "", "7"])
    lists = [[word() for _ in range(25)] for _ in range(3)]
    rows = [(d, " ".join(r.choice(lists[i % 3]) if r.random() < 0.9 else word() for i in range(r.randint(0, 60)))) for d in range(250)] + [(None, "Unknown words. Here"), (None, ""), (7, "one id again"), (7, "one id again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    setup = class_lm.Setup(classes=5, turns=3, head_share=0.008, least=4)
    m = class_lm.learn(df, setup)
    v = m.vocabulary
    assert 5 < v.head < v.end and m.information[-1] > m.information[0]
    shape = lambda w: v.end + 1 + int(class_lm.shapes(pa.array([w.encode()]))[0])
    number = lambda w, upto: v.end if w == "" else (lambda i: i if i < upto or v.end <= i else shape(w))(int(v.place(pa.array([w.encode()]))[0]))
    train = [lm_words(t) for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    counts = Counter(w for t in train for w in t)
    assert m.tokens == sum(counts.values()) and m.distinct == len(counts) and {w for w, c in counts.items() if c >= 4 and w} == {w for w in counts if w and number(w, v.end) < v.end}
    # the step beyond the head, by plain counts over classes of the head and of shapes
    before = [[number(w, v.head) for w in ["", *t]] for t in train]
    pairs = Counter((int(m.classes[a]), int(m.classes[b])) for t in before for a, b in zip(t, t[1:]))
    n = np.zeros((setup.all_classes,) * 2)
    for (a, b), c in pairs.items():
        n[a, b] = c
    link = class_lm.affinity(n)
    for w, c in counts.items():
        if w and v.head <= number(w, v.end) < v.end:
            near = [sum(link[k, m.classes[x[i + 2]]] + link[m.classes[x[i]], k] for x, t in zip(before, train) for i, y in enumerate(t) if y == w) for k in range(setup.classes)]
            assert near[m.classes[number(w, v.end)]] >= max(near) - 1e-9
    # the scores
    cls = lambda w: int(m.classes[number(w, v.end)])
    n = Counter((cls(a), cls(b)) for t in train for a, b in zip(["", *t], t))
    assert {(a, b): int(m.n[a, b]) for a, b in zip(*np.nonzero(m.n))} == n
    size, start, kinds = Counter(), Counter(), Counter(cls(w) for w in counts)
    for (a, b), c in n.items():
        start[a] += c
        size[b] += c
    t, total = setup.all_classes, sum(size.values())

    def brute(text):
        out, a = 0.0, cls("")
        for w in lm_words(text):
            b = cls(w)
            out += math.log10((n[a, b] + (size[b] + 0.1) / (total + 0.1 * t)) / (start[a] + 1)) + math.log10((counts[w] + 0.1) / (size[b] + 0.1 * (kinds[b] + 1)))
            a = b
        return out

    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_tokens, round(x.score, 6)) for x in class_lm.scores(df, m, setup).collect())
    assert got == sorted((d is None, d or 0, len(lm_words(x)), round(brute(x), 6)) for d, x in rows)
    held = class_lm.score(none)
    assert held.count() == 0


def test_clustered_words_beyond_a_bound(spark):
    """Where fewer words may be clustered than occur often, the others keep counts of their own."""
    r = random.Random(23)
    rows = [(d, " ".join(f"w{int(r.random() ** 2 * 60)}" for _ in range(50))) for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    setup = class_lm.Setup(classes=3, clustered=20, turns=1, head_share=0.03)
    m = class_lm.learn(df, setup)
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 10 for w in t.split())
    assert m.vocabulary.end == 20 and m.rare.count() == len(counts) - 20 and int(m.words.sum()) == len(counts) + 1
    n, v = m.tokens, m.distinct
    for x in class_lm.scores(df, m, setup).collect():
        w = lm_words(rows[x.doc_id][1])
        counts[""] = int(m.vocabulary.counts[-1])
        assert abs(x.base_score - sum(math.log10((counts[y] + 0.1) / (n + 0.1 * (v + 1))) for y in w)) < 1e-6 and x.n_known == sum(counts[y] > 0 for y in w)


def test_classes_follow_the_words(spark):
    """Texts that alternate two sorts of words: the class model predicts the sort, word counts can't."""
    r = random.Random(7)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(d, " ".join(r.choice((a, b)[i % 2]) for i in range(200))) for d in range(300)]
    out = class_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), class_lm.Setup(classes=4, turns=3)).filter("held_out").collect()
    per = lambda c: sum(r[c] for r in out) / sum(r.n_tokens for r in out)
    assert 10 ** -per("score") < 0.6 * 10 ** -per("base_score")


def test_lm_odd_rows(odd, none):
    got = {r.doc_id: r for r in class_lm.score(odd).collect()}
    assert class_lm.score(odd).count() == odd.count() == 14
    assert len(got) == 13 and got[7].n_tokens == 1 and got[5].n_tokens == 2 and got[32].n_tokens == 6001
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got.values())
    assert class_lm.score(none).count() == 0


# --- pipeline ---


def test_pipeline(spark, docs, tokenizer):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    judged = {r.doc_id: r.kept for r in quality.judge(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    good = {d: t for d, t in docs.items() if judged[d]}
    classes = brute_classes(good)
    stays = {d: t for d, t in good.items() if classes[d] == d}
    assert {r.doc_id for r in rows} == set(stays)
    replace = private.Replacer(queries.surrogate_key(spark))
    for d, t in stays.items():
        whole = [*tokenizer.encode(replace(t)[0], add_special_tokens=False).ids, 0]
        assert sum(r.length for r in rows if r.doc_id == d) == len(whole)
        first = min((r for r in rows if r.doc_id == d), key=lambda r: r.piece)
        assert first.ids_crc32 == zlib.crc32(np.array(whole[: first.length], "<u4").tobytes())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "best_fit_packing"]


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(DATA))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_odd_rows_and_on_none(spark, odd):
    """Nulls, empty and long texts, ties, repeated rows and an empty table: no stage fails, rows go only where a stage says so."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    for docs in (odd, odd.limit(0)):
        rows = [tuple(r) for r in docs.collect()]
        at = docs.columns.index("text")
        for name in ("quality_rules", "near_duplicates", "personal_data"):
            out = stages[name](spark, docs, "")
            assert out.columns == docs.columns
            got = out.collect()
            if name == "personal_data":
                assert len(got) == len(rows)
                assert sorted(r[at] is None for r in got) == sorted(r[at] is None for r in rows)
            else:
                assert not Counter(map(repr, map(tuple, got))) - Counter(map(repr, rows))
            if name == "quality_rules":
                assert all(r[at] for r in got)
        places = stages["best_fit_packing"](spark, docs, "").select("sequence_id", "offset", "length", "piece").collect()
        assert sum(r.piece == 0 for r in places) == len(rows)
        filled = defaultdict(list)
        for r in places:
            filled[r.sequence_id].append((r.offset, r.length))
        for parts in filled.values():
            end = 0
            for o, n in sorted(parts):
                assert o == end
                end += n
            assert end <= 2048
