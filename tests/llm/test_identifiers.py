import random
import re

import numpy as np
import pytest

from tideline.llm import identifiers as I


@pytest.mark.parametrize(("text", "want"), [
    ("write to a.b+c@mail.example.", ["a.b+c@mail.example"]), ("x (at) mail[dot]example now", ["x (at) mail[dot]example"]), ("A_1＠b.example.net据", ["A_1＠b.example.net"]),
    ("quote 1.5 @ close by", []), ("follow @someone", []), ("q @ w.example", ["q @ w.example"])])
def test_emails(text, want):
    assert [text[a:b] for a, b in I.emails(text)] == want


@pytest.mark.parametrize("phone", [
    "15434093098", "154-4994-7878", "160 4489 9790", "+86 154 3788 1234", "１５４９０７８２８７５", "+44 (0)20 7946 0970", "+44 7700 900203", "07700 900314", "020 7946 0094",
    "(662) 555-0197", "1 (566) 555 0182", "+1-373-555-0107", "735-555-0192", "773.555.0191", "+1 985 555 0129", "+49 30 23125-555", "(030) 23125 651", "0171 3920076"])
def test_phones(phone):
    text = f"call {phone} ext. 12."
    assert [(k, text[a:b]) for k, a, b in I.numbers(text)] == [("phone", phone)]


@pytest.mark.parametrize("text", ["2025-8531-20", "GC-2024-09-309", "375131952257905297", "1234567890123456789012345", "2370-2404, stop 2219.25", "1.5088/1.8760", "66,419.99"])
def test_no_phones(text):
    assert not list(I.numbers(text))


def test_resident_numbers():
    base = "99000019800229001"
    right = next(base + c for c in "0123456789X" if I.resident_number(base + c))
    assert I.resident_number(right.lower())
    assert sum(I.resident_number(base + c) for c in "0123456789X") == 1
    base = "99000019800230001"  # no such day
    assert not any(I.resident_number(base + c) for c in "0123456789X")


@pytest.mark.parametrize(("text", "want"), [
    ("moved from 660 Harrow Lane to 1753 Marlow Hill Street since", ["660 Harrow Lane", "1753 Marlow Hill Street"]), ("Flat 3, 692B Wexley Rd, Oxmere", ["692B Wexley Rd"])])
def test_streets(text, want):
    assert [m[0] for m in I._STREET.finditer(text)] == want


def test_other_streets():
    assert I._STRASSE.search("Frau X, Mühlweg 31b, bat")[0] == "Mühlweg 31b"
    text = "云洲市栖霞区云栖巷921号3单元"
    assert [text[a:b] for a, b in I.roads(text)] == ["云栖巷921号"]


@pytest.mark.parametrize("number", ["QQ465041B", "QQ 77 99 32 C", "988-39-8077", "930 24 2936"])
def test_other_identity_numbers(number):
    text = f"number {number}; tel"
    assert [(k, text[a:b]) for k, a, b in I.numbers(text)] == [("id_number", number)]


@pytest.mark.parametrize(("text", "want"), [
    ("江苏省苏州路88号", "苏州路88号"), ("广州市天河区广州路12号", "广州路12号"), ("公司位于中山北路12-3号，", "中山北路12-3号"), ("，人民路9号", "人民路9号"), ("住福州路３号", "福州路３号"), ("，呼伦贝尔布拉格东大街5号", "呼伦贝尔布拉格东大街5号")])
def test_roads(text, want):
    assert [text[a:b] for a, b in I.roads(text)] == [want]


def _words(known, common=(), ends=()):
    hashes = lambda ws: np.sort(np.array([I._word_hash(w) for w in ws], np.uint64))
    return I.Words(frozenset(known), hashes(common), hashes(ends))


def test_name_spans():
    words = _words({"loris", "june", "walker", "lane"}, {"redaktion"}, {"bank", "steel"})
    names = lambda t: [t[a:b] for a, b, *_ in I.latin_names(t, words)]
    assert names("By Oskova O'Umeetti today") == ["Oskova O'Umeetti"]
    assert names("for Hultetti, Solis; call") == ["Hultetti, Solis"]
    assert names("for Analyst Walker, June; call") == ["Walker, June"]  # two known parts beat one
    assert names("Mr Ketel Q. Nylund-Zel of") == ["Ketel Q. Nylund-Zel"]
    assert names("by Tornimum Bank Loris Hult") == ["Loris Hult"]
    assert names("Overnight, Vennimark Steel fell") == []
    assert names("Autor: J. Praona Redaktion: Coretti, Junind <x") == ["J. Praona", "Coretti, Junind"]
    assert names("said June Walker and Nathan Lane") == ["June Walker", "Nathan Lane"]  # words the seeds know


def _people(n):
    given = ["Loris", "Keta", "Wenel", "Tavira", "Oskel", "Junel"]
    family = ["Hultberg", "Dagsson", "Praetti", "Zelmere", "Okeona", "Nyovic"]
    return [f"{given[i % 6]} {family[(i // 6) % 6]}" for i in range(n)]


def test_found_and_redacted(spark):
    people = _people(36)
    rows = [(i, f"Analyst {p} wrote that prices rose. The firm Barin Steel said so.", "k") for i, p in enumerate(people)]
    zh = ["若", "望", "舒", "云", "清"]
    rows += [(100 + i, f"分析师{'禤佴'[i % 2]}{zh[i % 5]}{zh[(i * 3 + 1) % 5]}表示，价格上涨。", "k") for i in range(60)]
    rows += [(200, "Statements went to 12 Harrow Lane, Oxmere. Mail x@y.example or 15434093098.", "k"), (201, "In 2025 Wall Street desks and 6 High Street banks cut staff.", "k")]
    rows += [(300, None, "k"), (301, "", "k"), (302, "x" * 200_000, "k"), (303, rows[0][1], "k")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    seeds = spark.createDataFrame([("Loris", "given"), ("Hultberg", "family"), ("Dagsson", "family"), ("Keta", "given"), ("Wenel", "given"), ("禤", "family"), (None, None)], "name_part string, name_kind string")
    got = {tuple(r) for r in I.found(d, seeds).collect()}
    assert {(i, "name", p) for i, p in enumerate(people)} | {(303, "name", people[0])} <= got
    assert len([1 for i, k, v in got if 100 <= i < 160 and k == "name" and len(v) == 3]) == 60
    assert {(200, "address", "12 Harrow Lane"), (200, "email", "x@y.example"), (200, "phone", "15434093098")} <= got
    assert not any(i in (201, 300, 301, 302) for i, *_ in got)
    text = {r.doc_id: r.text for r in I.redacted(d, seeds).collect()}
    assert text[200] == "Statements went to <ADDRESS>, Oxmere. Mail <EMAIL> or <PHONE>." and text[300] is None and len(text) == len(rows)
    assert text[0] == "Analyst <NAME> wrote that prices rose. The firm Barin Steel said so."


def test_redaction_is_by_place(spark):
    """A value inside a longer word stays, and documents of one id keep their own places."""
    rows = [(i, f"Mr Loris Hult{x} met Loris Hult{x}ner twice.") for i, x in enumerate("abcdefgh")] + [(0, "x Mr Loris Hulta met nobody.")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    seeds = spark.createDataFrame([("Loris", "given"), *[(f"Hult{x}", "family") for x in "abcdefgh"]], "name_part string, name_kind string")
    got = sorted(r.text for r in I.redacted(d, seeds).collect())
    assert got == sorted(["Mr <NAME> met <NAME> twice."] * 8 + ["x Mr <NAME> met nobody."])


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    s = spark.createDataFrame([], "name_part string, name_kind string")
    assert I.found(d, s).count() == 0


def test_names_beside_many_copies_of_one_text(spark):
    chars = "若牧听知瑾远越溪雪舒望怀清云"
    rng = random.Random(5)
    rows = [(i, f"{rng.choice(['分析师', '记者'])}{'禤亓羿佴'[i // 14 % 4]}{chars[i % 14]}{rng.choice(chars)}{rng.choice(['表示', '报道'])}，价格{i}上涨。") for i in range(112)]
    rows += [(200, "分析师禤若霁表示，价格走低。"), (201, "分析师亓珩表示，价格走低。"), (202, "分析师羿若说明了原因。"), (203, "分析师羿若牧说明了原因。")]
    rows += [(300 + i, "分析师亓若牧认为，铜价上涨。") for i in range(240)] + [(600 + i, f"价格{i}走远了，清淡。") for i in range(364)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    seeds = spark.createDataFrame([(c, "family") for c in "禤亓羿"], "name_part string, name_kind string")
    got = {(r.doc_id, r.found_value) for r in I.found(d, seeds).collect()}
    want = {(i, re.search("[禤亓羿佴]..", t)[0]) for i, t in rows[:112]} | {(200, "禤若霁"), (201, "亓珩"), (202, "羿若"), (203, "羿若牧")} | {(300 + i, "亓若牧") for i in range(240)}
    assert got == want


def test_many_given_name_characters(spark):
    """No share of all names is asked of a character: a hundred of them, evenly used."""
    chars = [chr(0x6C00 + 7 * i) for i in range(100)]
    rows = [(i, f"分析师{'王禤'[i // 100 % 2]}{chars[i % 100]}{chars[(i * 37 + i // 100) % 100]}表示，价格{i}上涨。") for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    seeds = spark.createDataFrame([("王", "family"), ("禤", "family")], "name_part string, name_kind string")
    assert {(r.doc_id, r.found_value) for r in I.found(d, seeds).where("kind = 'name'").collect()} == {(i, t[3:6]) for i, t in rows}


def test_held_out_sentences(spark):
    """Sentences, names, streets and firms of other making than any table's: recall and precision."""
    rng = random.Random(8)
    given = [a + b for a in ("Al", "Bri", "Cor", "Da", "El", "Fi", "Ga", "Han") for b in ("ma", "net", "dric", "lya", "wen", "sto")]
    family = [a + b for a in ("Ash", "Brook", "Crane", "Dun", "Ever", "Fox", "Gran", "Hay", "Ing", "Jar") for b in ("worth", "ley", "stead", "combe", "vale", "man")]
    firms = [a + b for a in ("Zet", "Qor", "Vim", "Plo", "Tru", "Sno", "Kri", "Blu") for b in ("tix", "dana", "pex", "rulo", "mondo", "varis")]
    ends = ["Dynamics", "Logistics", "Timber", "Robotics"]
    people = ["{n} told reporters that output would recover.", "Our correspondent spoke with {n} on the phone.", "The award went to {n}, who retired last year.", "Chief Engineer {n} inspected the site.", "\"We expect more,\" {n} added.", "Photograph: {n}\n", "A letter from {n} arrived in the morning."]
    other = ["{f} reported a rise in orders.", "Shares of {f} were little changed.", "The Chief Engineer praised {f} on the phone.", "Rivals such as {f} cut prices.", "A letter from {f} arrived in the morning.", "The engineer of the site spoke to the chief of a rival."]
    rows, want = [], set()
    for i in range(3000):
        n, f = f"{rng.choice(given)} {rng.choice(family)}", f"{rng.choice(firms)} {rng.choice(ends)}"
        if rng.random() < 0.15:
            n = f"{n.split()[0]} {rng.choice('ABCDE')}. {n.split()[1]}"
        t = f"{rng.choice(other).format(f=f)} "
        if rng.random() < 0.6:
            t += rng.choice(people).format(n=n)
            want.add((i, n))
        rows.append((i, t + rng.choice(["", " Volumes fell.", " Nothing else was said."])))
    seeds = [(x, "given") for x in rng.sample(given, 16)] + [(x, "family") for x in rng.sample(family, 20)]
    got = {(r.doc_id, r.found_value) for r in I.found(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(seeds, "name_part string, name_kind string")).where("kind = 'name'").collect()}
    assert len(got & want) >= 0.95 * len(want), sorted(want - got)[:20]
    assert len(got & want) >= 0.95 * len(got), sorted(got - want)[:20]
