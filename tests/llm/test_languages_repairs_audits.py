"""Language identification, conversation repair and filter audit against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from strandlake.llm import audit, language, repair
from strandlake.llm.registry import oracle_sql, queries

WORDS = {
    "en": "the house of water and bread that is with you for the winter where we think other things".split(),
    "fr": "la maison des eaux et le pain que nous avons pour cet hiver où les autres choses sont à vous".split(),
    "de": "das haus der wässer und brot dass wir für den winter haben wo andere dinge bei euch sind".split(),
}


# Languages


def plain_counts(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    found = Counter()
    for w in words:
        found.update(w)
        for n in (2, 3):
            padded = f" {w} "
            found.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if n == 2 or g[1] != " ")
    return found


def plain_number(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def plain_ranking(counts, most):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], plain_number(x[0])))[:most]]


def plain_language(text, profiles, most):
    own = plain_ranking(plain_counts(text), most)
    if not own or not profiles:
        return "und", 0.0
    far = {lang: sum(abs(k - p[g]) if g in p else most for k, g in enumerate(own)) / (most * len(own)) for lang, p in profiles.items()}
    lang = min(far, key=lambda x: (far[x], x))
    return lang, 1 - far[lang]


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def language_rows():
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 40))), lang) for k, lang in enumerate(rng.choice(list(WORDS)) for _ in range(80))]
    odd = [None, "", " \n\t", "12 34 ²½Ⅷ __", "x", "İstanbul ΣΑΣ naïve", "a²b", "中文 字", rows[0][1], rows[0][1]]
    return rows + [(100 + k, t, None) for k, t in enumerate(odd)] + [(None, "the house", "en"), (3, rows[3][1], rows[3][2]), (900, "la maison " * 60_000, "fr"), (901, None, "fr")]


@pytest.mark.parametrize("at_once", [200, 2])
def test_languages_equal_plain_rankings(spark, monkeypatch, at_once):
    monkeypatch.setattr(language, "AT_ONCE", at_once)
    rows = language_rows()
    docs = documents(spark, rows)
    found = language.predict(docs, language.profiles(docs))
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    learned = {}
    for _, text, lang in rows:
        if lang is not None:
            learned.setdefault(lang, Counter()).update(plain_counts(text))
    profiles = {lang: {g: k for k, g in enumerate(plain_ranking(c, language.PROFILE))} for lang, c in learned.items()}
    want = [(i, t, *plain_language("" if t == "12 34 ²½Ⅷ __" else (t or "").replace("²", " "), profiles, language.PROFILE)) for i, t, _ in rows]
    key = lambda r: (str(r[0]), r[1] or "", r[2], round(r[3], 9))
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r.text, r.lang_pred, r.score)) for r in found.collect())


def test_languages_of_nothing(spark):
    docs = documents(spark, [(1, "the house", None), (2, None, None)])
    assert {(r.lang_pred, r.score) for r in language.predict(docs, language.profiles(docs)).collect()} == {("und", 0.0)}
    assert language.predict(docs.limit(0), language.profiles(docs.limit(0))).count() == 0


def test_long_texts_are_counted_in_pieces():
    plain = language.letters("Ein sehr langer Satz, 12 mal. " * 50)
    whole, pieces = language.counted(plain), language.counted(plain, 64)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
    assert {int(k): int(n) for k, n in zip(*whole, strict=True)} == {plain_number(g): n for g, n in plain_counts(plain).items()}


def test_held_out_languages_are_found(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries()["op11_language_id"](spark, sf_dir).collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(true) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.98 * len(held)


# Conversations


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            yield from [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)


GRAMMAR = re.compile("(s?(ua)+)?")


def plain_edits(symbols):
    """Every sequence of edits of (initial, must go, truncated), with up to two turns put in at each place."""
    put = ["", "u", "a", "ua", "au"]
    best = None
    ways = []
    for initial, gone, cut in symbols:
        ways.append([(3, "D", "")] + ([] if gone else [(cut, "K", initial), (2 + cut, "R", "u"), (2 + cut, "R", "a")]))
    for chosen in itertools.product(*ways):
        for added in itertools.product(put, repeat=len(symbols) + 1):
            out = added[0] + "".join(c[2] + a for c, a in zip(chosen, added[1:], strict=True))
            if GRAMMAR.fullmatch(out):
                labels = "I" * len(added[0]) + "".join(c[1] + "I" * len(a) for c, a in zip(chosen, added[1:], strict=True))
                cost = sum(c[0] for c in chosen) + 2 * sum(map(len, added))
                best = min(best or (cost, labels), (cost, labels))
    return best


def plain_repair(conv, rows):
    rows = sorted((r for r in rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{' ' if conv is None else conv}:{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [(r[2][:1] if r[2][:1] in "sua" else "-") or "-" for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit_ = plain_edits([(i, f in ("blank", "duplicate"), int(f == "truncated")) for i, f in zip(initials, faults, strict=True)]) if rows else (0, "")
    lines, at, length = [], 0, len(audit_) - audit_.count("D")
    shape = "s" * (length % 2) + "ua" * (length // 2)
    for label in audit_:
        role, text = ("", "") if label == "I" else rows[at][2:]
        at += label != "I"
        if label != "D":
            lines.append(f"{role if label == 'K' else {'u': 'user', 'a': 'assistant'}[shape[len(lines)]]}:{text}")
    count = Counter(faults)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit_, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, audit string, copies int")


def test_repairs_equal_all_edits(spark):
    rng = random.Random(12)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 3)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 5]), role, rng.choice(["Yes.", "No", "Why?\n ", "", None, " \t", "Ünï. ok", "long! " * 3000])))
    rows += [(70, None, "user", "a."), (70, None, "user", "a."), (71, 1, "user", "Same."), (71, 2, "assistant", "Sure!"), (71, 9, "user", "Same.")]
    found = repair.repair(conversations(spark, rows))
    by = {}
    for r in plain_damage(rows):
        by.setdefault(r[0], []).append(r)
    ids = {r[0] for r in rows}
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in found.collect()), key=order) == sorted((plain_repair(c, by.get(c, [])) for c in ids), key=order)
    assert {c for c in ids if c not in by}, "one conversation should lose all its turns"
    assert repair.repair(conversations(spark, [])).count() == 0


def test_long_conversations_are_repaired():
    symbols = bytes([3, 6, 3, 7, 2, 4, 5, 8]) * 5000
    cost, labels = repair.shortest(symbols)
    assert len(labels) - labels.count("I") == len(symbols) and cost > 0
    assert repair.shortest(b"") == (0, "")


def test_a_tie_takes_the_label_that_sorts_first():
    # User, user, assistant: a reply put in between costs 2, dropping either 3.
    assert repair.shortest(bytes([3, 3, 6])) == plain_edits([("u", False, 0), ("u", False, 0), ("a", False, 0)]) == (2, "KIKK")
    # A lone assistant turn: a user turn before it (IK) or another role and a reply (RI) cost more or sort later.
    assert repair.shortest(bytes([6])) == plain_edits([("a", False, 0)]) == (2, "IK")


# Audits


def plain_audit(rows, labels):
    """Every order, filter by filter, on the rows themselves."""
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    quality, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))

    def failing(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and least[text] < i}
        return {f for f, bad in tests.items() if bad}

    parts = {}
    for i, lang, t in rows:
        parts.setdefault(lang or "", []).append((failing(i, t or ""), i in quality, i in toxic))
    out = {}
    for part, docs in parts.items():
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                redundant = sum(f in d[0] for d in docs) - len(gone)
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited_rows():
    rng = random.Random(13)
    texts = [None, "", "short", "SHOUT LOUD " * 60, "a b c " * 40, " ".join(f"w{k}" for k in range(150)), " ".join(f"w{k}" for k in range(150)) + " 50% off", "x " * 200_000 + "é"]
    rows = [(rng.choice([None, *range(30)]), rng.choice(["en", "fr", None, ""]), rng.choice(texts[:-1])) for _ in range(120)]
    rows += [(k, "en", "copied text") for k in range(40)] + [(5, "en", "copied text"), (77, "fr", texts[-1]), (78, "fr", texts[-1])]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(60)] + [(1, 1, 0), (1, 0, 1), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("chunk", [audit.CHUNK_BYTES, 300])
def test_audit_equals_filtering(spark, monkeypatch, chunk):
    rows, labels = audited_rows()
    docs = spark.createDataFrame([(*r, 3, b"x") for r in rows], "doc_id long, lang string, text string, mask int, part binary").repartition(7)
    known = spark.createDataFrame([(*r, "n") for r in labels], "doc_id long, quality int, toxic int, part string")
    monkeypatch.setattr(audit.sent, "__defaults__", (chunk,))
    found = audit.interactions(docs, known)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.collect()} == plain_audit(rows, labels)
    assert found.count() == 600 * len({r[1] or "" for r in rows})
    assert audit.interactions(docs.limit(0), known).count() == 0


def test_texts_of_one_hash_form_a_chain(monkeypatch):
    monkeypatch.setattr(audit, "fingerprint", lambda text: 7)
    rows = [(3, "en", "a"), (1, "en", "b"), (2, "fr", "a"), (9, "en", "b"), (4, "en", "c")]
    routed = sorted([*audit.sent(rows[:3]), *audit.sent(rows[3:])], key=lambda r: r[0])
    copies = {(i, bool(m & audit.COPY)) for i, _, m, _ in audit.received(routed)}
    assert copies == {(3, True), (1, False), (2, False), (9, True), (4, False)}


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_filter_audit"])
def test_sql_agrees(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = con.execute(oracle_sql()[name]).df(), queries()[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))
