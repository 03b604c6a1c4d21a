"""Personal information inside free text, found and replaced.

Addresses of e-mail, telephone numbers and identity numbers have shapes that
decide by themselves (identity numbers with their check characters), and so have
Chinese and German street addresses. Names and other street addresses are found
by bootstrapping: seed entities (the parts of names that are known; streets that
stand before a town) show the lexical patterns around them; patterns and
instances form a bipartite graph that is scored in rounds: a pattern is as good
as the instances it holds, an instance as good as its best pattern; the patterns
that end with a high score discover identifiers that no seed knows, and those
that end with a low one take back a name of which a seed knows only a part.

Which capital words are no part of a name is learned too, from the whole corpus:
words that also stand in lower case in several surroundings, words that stand
before or behind whole names rather than before a part of one, and words that end two-word spans whose other words the seeds know far less often than they know
the partners of names (the words that end firms' names). A word the seeds know,
or one that stands beside known parts as often as names do, is no such word. Only
closed classes are given: titles, pronouns, articles, prepositions, months and
days, legal forms of firms, and words that end a street's name.

Chinese names have no capital letters, so their patterns are induced from seed
surnames in a first pass; the second pass proposes every instance of any kind
with its patterns, and only these proposals go through the graph. The first pass
counts distinct surroundings, so copies of a text weigh nothing, and asks for no
share of all names: a character begins given names if it follows two seed
surnames, or one that is mostly followed by such characters, or stands mostly in
their patterns; it ends them if it stands mostly between them and the right side
of a pattern.

What is sent to the tasks is bounded and checked: the seed list (at most MAX_SEEDS
parts), the patterns (at most MAX_PATTERNS), the learned words (at most MAX_WORDS,
eight bytes each), and characters. Beyond a bound the query stops with an error.

Defined results: null and empty texts hold nothing; a value is reported once a
document and kind, exactly as written; repeated documents are all reported;
without seeds no name is found by seed, only shapes and streets; other columns
are not looked at. Where two kinds claim the same characters the first of
e-mail, number, address, name has them.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import cut, hot_rows, salted_join, spread

MAX_SEEDS = 100_000
MAX_PATTERNS = 200_000
MAX_WORDS = 5_000_000
#: Distinct instances a pattern needs, the rounds of scoring, and the score that counts.
SUPPORT, ROUNDS, ACCEPT, ACCEPT_CAPITALS = 3, 3, 0.5, 0.85
#: Score of all its patterns below which a name that is known by one part only is taken back.
REJECT = 0.1
#: Known partners of a word that are too few: under this share of what a name's partners would be, and so many deviations below.
TOO_FEW, DEVIATIONS = 0.25, 2.8

# ---- shapes -----------------------------------------------------------------

_AT = r"(?: ?[@＠] ?| ?[(\[{] ?at ?[)\]}] ?)"
_DOT = r"(?:[.．]| ?[(\[{] ?dot ?[)\]}] ?)"
# the searches start at the rarest part of a shape and look left and right of it; repeats are bounded
_LOCAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+'\-]{0,63}\Z")
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9\-]{{0,61}}[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]{{0,61}}[A-Za-z0-9])?)+", re.I | re.A)
_SIGN = re.compile(_AT, re.I)
_SPELT = re.compile(r"[(\[{] ?[Aa][Tt] ?[)\]}]")

_D, _B = "[0-9０-９]", r"(?<![0-9０-９A-Za-z.,_\-/])"
_E = r"(?![0-9０-９A-Za-z_]|[\-./,][0-9０-９])"
_S = r"[ \-.]"
_PHONE = re.compile(
    _B + "(?:"
    rf"(?:[+＋]86{_S}?)?1[3-9]{_D}{_S}?{_D}{{4}}{_S}?{_D}{{4}}"  # Chinese mobile
    rf"|１[３-９][０-９]{{9}}"
    rf"|(?:[+＋]86{_S}?)?0{_D}{{2,3}}{_S}{_D}{{7,8}}"  # Chinese landline
    rf"|[+＋]44 ?(?:\(0\) ?)?(?:7{_D}{{3}} ?{_D}{{6}}|7{_D}{{3}} ?{_D}{{3}} ?{_D}{{3}}|{_D}{{2}} ?{_D}{{4}} ?{_D}{{4}}|{_D}{{3,4}} ?{_D}{{3}} ?{_D}{{3,4}})"
    rf"|0(?:7{_D}{{3}} ?{_D}{{6}}|7{_D}{{3}} {_D}{{3}} {_D}{{3}}|{_D}{{2}} {_D}{{4}} {_D}{{4}}|{_D}{{3}} {_D}{{3}} {_D}{{4}})"  # British
    rf"|[+＋]49 ?(?:\(0\) ?)?{_D}{{2,4}}[ /\-]?{_D}{{3,8}}(?:[ \-]{_D}{{1,5}})?"
    rf"|\(0{_D}{{2,4}}\) ?{_D}{{3,8}}(?:[ \-]{_D}{{1,5}})?"  # German
    rf"|01[5-7]{_D} ?{_D}{{7,8}}"
    rf"|0{_D}{{2,4}}[ /]{_D}{{5,8}}(?:[ \-]{_D}{{1,5}})?"
    rf"|(?:[+＋]?1{_S}?)?\({_D}{{3}}\) ?{_D}{{3}}{_S}{_D}{{4}}"  # North American
    rf"|(?:[+＋]?1{_S})?{_D}{{3}}{_S}{_D}{{3}}{_S}{_D}{{4}}"
    rf"|[+＋][1-9]{_D}{{0,2}}(?:[ \-]{_D}{{2,5}}){{2,4}}"  # any other country
    ")" + _E
)
_RESIDENT = re.compile(r"(?<![0-9０-９A-Za-z])[0-9０-９]{17}[0-9０-９XxＸｘ](?![0-9０-９A-Za-z])")
_SSN = re.compile(r"(?<![0-9A-Za-z.,\-/])[0-9]{3}([\- ])[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z]|[\-.,][0-9])")
_NINO_DIGITS = re.compile(r"[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-Da-d](?![0-9A-Za-z])")
_NINO_LETTERS = re.compile(r"(?<![0-9A-Za-z])[A-Za-z]{2} ?\Z")
#: Stretches long enough for a telephone, resident or social-security number.
_DIGITS = re.compile(r"[+＋(0-9０-９][0-9０-９ ()\-./+＋]{7,}")
#: Weights and check characters of the Chinese resident number.
_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
_CHECKS = "10X98765432"


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    if "@" in text or "＠" in text or _SPELT.search(text):
        for m in _SIGN.finditer(text):
            left = _LOCAL.search(text, max(end, m.start() - 64), m.start())
            right = left and _DOMAIN.match(text, m.end())
            if right:
                end = right.end()
                yield left.start(), end


def numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of identity and telephone numbers, without overlaps."""
    for run in _DIGITS.finditer(text):
        i = run.start()
        while i < run.end():
            m = _RESIDENT.match(text, i)
            kind = "id_number" if m and resident_number(m[0]) else None
            if not kind and (m := _SSN.match(text, i)):
                kind = "id_number"
            if not kind and (m := _PHONE.match(text, i)):
                kind = "phone"
            if kind:
                yield kind, i, m.end()
                i = m.end()
            else:
                i += 1
    for m in _NINO_DIGITS.finditer(text):
        if left := _NINO_LETTERS.search(text, max(0, m.start() - 4), m.start()):
            yield "id_number", left.start(), m.end()


def roads(text: str) -> Iterator[tuple[int, int]]:
    """Road name and house number: what stands behind the last town, district or preposition.

    A sign of a town right before the word for road is the road's own (苏州路).
    """
    for m in _ROAD.finditer(text):
        near = re.search(rf"{_HAN}{{1,12}}\Z", text[max(0, m.start() - 12) : m.start()])
        if near and (name := _ROAD_NAME.match(near[0])):
            yield m.start() - len(name[1]), m.end()


def resident_number(v: str) -> bool:
    """Right check character and a date of birth that exists."""
    v = unicodedata.normalize("NFKC", v).upper()
    if _CHECKS[sum(int(c) * w for c, w in zip(v[:17], _WEIGHTS, strict=True)) % 11] != v[17]:
        return False
    try:
        return 1850 <= date(int(v[6:10]), int(v[10:12]), int(v[12:14])).year <= 2100
    except ValueError:
        return False


# ---- candidates of streets and names ----------------------------------------

#: Words that end a street's name.
_STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Close|Crescent|Cres|Way|Court|Ct|Place|Pl|Square|Sq|Terrace|Boulevard|Blvd|Gardens|Grove|Row|Mews|Parade|Walk|Hill|Quay|Wharf|Gate"
_STREET = re.compile(rf"(?<![\w.,\-/])\d{{1,5}}[A-Za-z]?(?:-\d{{1,5}})? ((?:[A-Z][\w'’\-]+ ){{1,3}}?(?:{_STREETS}))\b(?! (?:{_STREETS})\b)")
_STRASSE = re.compile(r"(?<!\w)([A-ZÄÖÜ][\wäöüß\-]{0,40}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm|steig|markt|chaussee)|[A-ZÄÖÜ][\wäöüß\-]+ (?:Straße|Str\.|Weg|Gasse|Platz|Allee|Ring|Damm)) \d{1,4} ?[a-z]?(?![\w])")
_ROAD = re.compile(r"(?:大道|大街|路|街|巷|胡同|弄|里|道)[0-9０-９]{1,5}(?:[-－][0-9０-９]{1,5})?号")
#: Signs that end a province, town or district, and words that stand before a place.
_ROAD_NAME = re.compile(r"(?:.*(?:[市区县镇乡省州](?=.)|位于|在|于|到|至|往|从|住|址))?([一-鿿]{1,12})\Z", re.S)

_TOWN = re.compile(r", ([A-Z][\w'’\-]+)")

#: Fixed values, closed classes only: titles, articles, prepositions, pronouns, days, months, legal forms of firms, parts of an address, labels of contact lines.
_NO_NAME = frozenset(
    "mr mrs ms miss dr prof sir herr herrn frau the a an and or for of in on at by from to von an der die das den dem des ein eine "
    "this that these those it its we they he she i i'll i'm i've i'd there here when where while after before during since q "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "group company inc ltd plc llc corp ag gmbh holdings flat unit apt suite tel telefon phone mobile mobil fax email mail".split()
)
_STREET_ENDS = frozenset(_STREETS.lower().split("|"))
_NO_NAME |= _STREET_ENDS
_LETTER = "[^\\W\\d_]"
_CAP = f"(?:[A-ZÀ-ÖØ-ÞĀ-Ž]['’])?[A-ZÀ-ÖØ-ÞĀ-Ž](?:{_LETTER}|[̀-ͯ'’])+(?:-(?:[A-ZÀ-ÖØ-ÞĀ-Ž]['’])?[A-ZÀ-ÖØ-ÞĀ-Ž](?:{_LETTER}|[̀-ͯ'’])+)*"
# a word begins behind no word character, @ or dot; that is looked at where a capital stands, not at every character
_WORD = re.compile(rf"(?:{_CAP}(?![\w@])|[A-Z]\.(?=[  ]))")
_GAP = re.compile(r"[  ]{1,3}\Z")
_COMMA = re.compile(r",[  ]{1,2}\Z")
_LISTED = re.compile(r",\s{1,2}[A-ZÀ-ÖØ-ÞĀ-Ž]")
_TOKEN = re.compile(r"\n|[^\W_]+(?:['’\-][^\W_]+)*|[^\s\w]|_")
_NUMBER = re.compile(r"\d+")
_HAN = "[一-鿿]"


@functools.lru_cache(200_000)
def part_key(token: str) -> tuple[str, ...]:
    """Name parts of a token: no case, no marks, no O', hyphens apart."""
    flat = token.lower()
    if not token.isascii():
        flat = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c)).lower().replace("’", "'")
    return tuple(x.split("'", 1)[1] if x[1:2] == "'" else x for x in flat.split("-"))


def _form(token: str) -> str:
    """A token as patterns have it: lower case, runs of digits alike."""
    return token.lower() if token.isalpha() else _NUMBER.sub("9", token.lower())


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns around a span: two words to the left, two to the right, one on each side."""
    left = [_form(x) for x in _TOKEN.findall(text[max(0, start - 40) : start])[-2:]]
    right = [_form(x) for x in _TOKEN.findall(text[end : end + 40])[:2]]
    if start <= 40:
        left = ["^", "^", *left][-2:]
    if len(text) - end <= 40:
        right = [*right, "$", "$"][:2]
    # a text's ends and line ends are alike
    left, right = ["\n" if x == "^" else x for x in left], ["\n" if x == "$" else x for x in right]
    return ["l " + " ".join(left), "r " + " ".join(right), "b " + " ".join((*left[-1:], "|", *right[:1]))]


class Words:
    """Capital words that are no part of a name: the closed classes and the learned ones, as sorted hashes."""

    def __init__(self, known: frozenset[str], common: np.ndarray | None = None, ends: np.ndarray | None = None) -> None:
        none = np.empty(0, np.uint64)
        self.known, self.common, self.ends = known, none if common is None else common, none if ends is None else ends
        self.asked: dict[str, tuple[bool, bool]] = {}

    def of(self, word: str) -> tuple[bool, bool]:
        """(no part of a name, ends the name of a firm or street) of a lower-case word."""
        got = self.asked.get(word)
        if got is None:
            if len(self.asked) > 500_000:
                self.asked.clear()
            h = np.uint64(_word_hash(word))
            ends = word in _STREET_ENDS or _has(self.ends, h)
            stop = ends or word in _NO_NAME or _has(self.common, h)
            # a part the seeds know is a name's, whatever else it may be; a street's or firm's end is told by the word before it
            got = self.asked[word] = (stop and not all(p in self.known for p in part_key(word)), ends)
        return got


def _has(table: np.ndarray, h: np.uint64) -> bool:
    i = int(np.searchsorted(table, h))
    return i < len(table) and bool(table[i] == h)


def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def capital_words(text: str) -> Iterator[re.Match]:
    at = 0
    while m := _WORD.search(text, at):
        i = m.start()
        if i and ((x := text[i - 1]) in "@._" or x.isalnum()):
            at = i + 1
        else:
            yield m
            at = m.end()


def capital_runs(text: str, words: Words) -> list[list[re.Match]]:
    """Capital words that stand side by side, without those that are no part of a name."""
    runs: list[list[re.Match]] = []
    for m in capital_words(text):
        initial = len(m[0]) == 2 and m[0][1] == "."
        stop, ends = (False, False) if initial else words.of(m[0].lower().rstrip("."))
        beside = bool(runs and runs[-1] and _GAP.match(text, runs[-1][-1].end(), m.start()))
        if stop:
            if ends and beside:
                runs[-1].pop()
            runs.append([])
        elif beside:
            runs[-1].append(m)
        else:
            runs.append([m])
    return runs


def latin_names(text: str, words: Words, places: frozenset[int] | set[int] = frozenset()) -> list[tuple[int, int, str, int]]:
    """(start, end, key, known parts) of spans that are written like a full name.

    ``places``: where a town begins that follows a street.
    """
    known = words.known
    runs = capital_runs(text, words)
    out = []

    def offer(ms: list[re.Match]) -> None:
        parts = [p for m in ms if m[0][-1] != "." for p in part_key(m[0])]
        if parts and sum(len(p) > 1 for p in parts):
            out.append((ms[0].start(), ms[-1].end(), " ".join(sorted(parts)), sum(p in known for p in parts)))

    score = lambda u: sum(p in known for m in u for p in part_key(m[0].rstrip(".")))

    def listed(n: int) -> list[re.Match]:
        """Family name, comma, given name, where run n ends with the one and the next run is the other."""
        nxt = runs[n + 1] if n + 1 < len(runs) else []
        last = runs[n][-1]
        if not nxt or last[0][-1] == "." or nxt[0][0][-1] == "." or not _COMMA.match(text, last.end(), nxt[0].start()):
            return []
        return [last, *nxt] if len(nxt) == 1 or len(nxt) == 2 and nxt[1][0][-1] == "." else []

    for n, run in enumerate(runs):
        if not run:
            continue
        turned = listed(n)
        if len(run) == 1:
            if turned:
                offer(turned)
            continue
        if turned and score(turned) > score(run[-2:]):  # a word before a name that is written the other way round
            offer(turned)
            run = run[:-1]
            if len(run) == 1:
                continue
        # given name, initials, family name; longer runs hold several
        units: list[list[re.Match]] = []
        i = 0
        while i < len(run):
            j = i + 1
            while j < len(run) - 1 and run[j][0][-1] == ".":
                j += 1
            if j < len(run) and run[j][0][-1] != ".":
                units.append(run[i : j + 1])
            i += 1
        best: list[list[re.Match]] = []
        if run[0].start() in places:  # the town after a street
            units = [u for u in units if u[0] is not run[0]]
        initial = lambda u: u[0] is run[0] and u[0][0][-1] == "."
        for u in sorted(units, key=lambda u: (-score(u), not initial(u), -len(u), -u[0].start() if len(run) == 3 else u[0].start())):
            if all(u[-1].end() <= b[0].start() or u[0].start() >= b[-1].end() for b in best):
                best.append(u)
        for u in best:
            offer(u)
    return out


# ---- Chinese names ----------------------------------------------------------


def _edge(s: str, side: int) -> str:
    """One sign next to a Chinese name, two if the first is a Chinese character; line ends are |\\n|."""
    s = s.replace("\r", "")
    s = s.rstrip(" 　\xa0\t") if side < 0 else s.lstrip(" 　\xa0\t")
    if not s:
        return "\n"
    x = s[-1] if side < 0 else s[0]
    if side > 0 and "一" <= x <= "鿿":
        return s[:2]
    return "9" if x.isdigit() else x


#: Surroundings of a lower-case word are told apart by so many classes of the word before it.
_CLASSES = 16


def _evidence(surnames: frozenset[str], known: frozenset[str]):
    """First pass, distinct rows (k, c, l, after) of a batch.

    k = z: seed surname, sign on the left, what follows. k = w: the two words of a span of two capital words, and for each 1 if the seeds know it.
    k = o: an unknown capital word, and the two after it of which one is known; k = t: the same with the two before it. k = l: lower-case word, class of the word before it.
    """
    find = re.compile("[" + "".join(sorted(surnames)) + f"](?={_HAN})") if surnames else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(known)
        for b in batches:
            classes: dict[str, str] = {}
            rows: set[tuple[str, str, str, str]] = set()
            for t in b.column("text").to_pylist():
                for m in find.finditer(t) if find else ():
                    k = m.start()
                    rows.add(("z", t[k], _edge(t[max(0, k - 4) : k], -1), t[k + 1 : k + 8]))
                for r in capital_runs(t, words):
                    # before a comma and a capital word the last word may begin a name of its own
                    if len(r) == 2 and r[0][0][-1] != "." and r[1][0][-1] != "." and not _LISTED.match(t, r[1].end()):
                        a, b = (x[0].lower() for x in r)
                        rows.add(("w", a, b, "".join(str(int(all(p in known for p in part_key(x)))) for x in (a, b))))
                    for x, *rest in zip(r, r[1:], r[2:]):
                        if x[0][-1] != "." and all(y[0][-1] != "." for y in rest):
                            name = [y[0].lower().rstrip(".") for y in rest]
                            if any(p in known for y in name for p in part_key(y)) and not all(p in known for p in part_key(x[0])):
                                rows.add(("o", x[0].lower(), " ".join(name), ""))
                            first = x[0].lower()
                            if any(p in known for y in (first, name[0]) for p in part_key(y)) and not all(p in known for p in part_key(name[1])):
                                rows.add(("t", name[1], first, name[0]))
                before, tokens = "", t.split()
                for i, x in enumerate(tokens):
                    if not x.islower():
                        continue
                    w = x.lstrip("(").rstrip(",.;:!?)")
                    # not before what may spell an address out
                    if w.isalpha() and 1 < len(w) <= 40 and w < "\u0250" and (i + 1 == len(tokens) or tokens[i + 1][0] not in "[({@＠"):
                        if (c := classes.get(before)) is None:
                            c = classes[before] = str(_word_hash(before) % _CLASSES)
                        rows.add(("l", w, c, ""))
                        before = w
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in cols], ["k", "c", "l", "after"])

    return run


def learned_words(evidence: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that also stand in lower case or before whole names, and of those that end names of firms."""
    flag = lambda i: F.substring("after", i, 1) == "1"
    spans = evidence.where("k = 'w'").select(F.col("c").alias("a"), F.col("l").alias("b"), flag(1).alias("ka"), flag(2).alias("kb"))
    # how many partners of a known last word the seeds know: what a name's partners would be
    base = spans.where("kb").agg(F.avg(F.col("ka").cast("double")).alias("c")).first()["c"] or 0.0
    last = spans.groupBy("b").agg(F.count("*").alias("n"), F.count_if("ka").alias("hit"), F.first("kb").alias("kb"))
    expected = F.col("n") * base
    few = (F.col("hit") <= expected * TOO_FEW) & (F.col("hit") < expected - DEVIATIONS * F.sqrt(expected))
    ends = last.where(~F.col("kb") & few).select(F.col("b").alias("w"))
    # words in lower case, unless they stand beside known parts as names do
    both = spans.select(F.col("a").alias("w"), F.col("kb").alias("hit")).unionAll(spans.select(F.col("b").alias("w"), F.col("ka").alias("hit")))
    beside = both.groupBy("w").agg(F.count("*").alias("n"), F.count_if("hit").alias("hit")).where(
        (F.col("hit") >= SUPPORT) & (F.col("hit") >= F.col("n") * max(base * ACCEPT, 0.01))).select("w")
    common = evidence.where("k = 'l'").groupBy(F.col("c").alias("w")).agg(F.count_distinct("l").alias("n")).where(F.col("n") >= SUPPORT)
    # words before whole names more often than before a known part alone: roles
    whole = evidence.where("k = 'o'").groupBy(F.col("c").alias("w")).agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    alone = spans.where("kb").groupBy(F.col("a").alias("w")).agg(F.count("*").alias("alone"))
    roles = whole.join(alone, "w", "left").where(F.col("n") > F.coalesce("alone", F.lit(0))).select("w")
    common = cut(common.select("w").join(beside, "w", "left_anti").unionAll(roles).distinct())
    # and words behind whole names, unless what stands before is itself a role and a part of the name
    behind = evidence.where("k = 't'").select(F.col("c").alias("v"), F.col("l").alias("w"), "after").join(common, "w", "left_anti")
    behind = behind.groupBy(F.col("v").alias("w")).agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    family = spans.where("ka").groupBy(F.col("b").alias("w")).agg(F.count("*").alias("alone"))
    common = common.unionAll(behind.join(family, "w", "left").where(F.col("n") > F.coalesce("alone", F.lit(0))).select("w")).distinct()
    out = []
    for words in (common, ends):
        rows = words.limit(MAX_WORDS + 1).toArrow().column("w").to_pylist()
        if len(rows) > MAX_WORDS:
            raise ValueError(f"more than {MAX_WORDS} words that are no names; they are shipped to every task")
        out.append(np.sort(np.fromiter(map(_word_hash, rows), np.uint64, len(rows))))
    return out[0], out[1]


def _right(rest: Column) -> Column:
    """The sign on the right, as `_edge` has it, of what follows a name."""
    rest = F.regexp_replace(rest, "^[ 　\xa0\\t\\r]+", "")
    head = F.substring(rest, 1, 1)
    return F.when(rest == "", "\n").when(head.rlike(_HAN), F.substring(rest, 1, 2)).when(head.rlike("[0-9０-９]"), "9").otherwise(head)


def _patterns(around: DataFrame, first: str, second: str) -> DataFrame:
    """(l, r, n): surroundings of at least two distinct names of a seed surname and given-name characters."""
    named = around.withColumn("name", F.regexp_extract("after", f"^[{first}][{second}]?", 0)).where("name != ''")
    named = named.select("l", _right(F.expr("substring(after, 1 + length(name))")).alias("r"), "c", "name").distinct()
    return named.groupBy("l", "r").agg(F.count("*").alias("n")).where("n >= 2")


def _firsts(pairs: dict[tuple[str, str], tuple[int, int]]) -> str:
    """Characters that begin given names; ``pairs``: surname and next character, with their surroundings and those in patterns."""
    after: dict[str, dict[str, tuple[int, int]]] = {}
    before: dict[str, dict[str, tuple[int, int]]] = {}
    for (c, h), n in pairs.items():
        after.setdefault(c, {})[h] = n
        before.setdefault(h, {})[c] = n
    first = {h for h, cs in before.items() if len(cs) >= min(2, len(after))}
    while True:
        # a surname that is mostly followed by them is no common word: whatever follows it begins a name
        good = {c for c, hs in after.items() if sum(n for h, (n, _) in hs.items() if h in first) >= ACCEPT * sum(n for n, _ in hs.values())}
        more = {h for h, cs in before.items() if sum(n if c in good else held for c, (n, held) in cs.items()) >= ACCEPT * sum(n for n, _ in cs.values())} - first
        if not more:
            return "".join(sorted(first))
        first |= more


def given_names(around: DataFrame) -> tuple[str, str]:
    """Characters that begin and that end given names, from the distinct surroundings of seed surnames."""
    heads = around.select("c", F.substring("after", 1, 1).alias("h"), "l", "after")
    # at most all pairs of characters there are
    pairs = {(r.c, r.h): r.n for r in heads.groupBy("c", "h").agg(F.count("*").alias("n")).collect()}
    first = _firsts({k: (n, 0) for k, n in pairs.items()})
    if not first:
        return "", ""
    p = cut(_patterns(around, first, first))
    if any(h not in first for _, h in pairs):
        sides = heads.select("*", F.explode(F.array(*[_right(F.expr(f"substring(after, {i})")) for i in (2, 3)])).alias("r"))
        held = sides.join(p, ["l", "r"], "left_semi").select("c", "h", "l", "after").distinct().groupBy("c", "h").agg(F.count("*").alias("n"))
        stands = {(r.c, r.h): r.n for r in held.collect()}
        first = _firsts({k: (n, stands.get(k, 0)) for k, n in pairs.items()})
    # other second characters: the surroundings with them are a better pattern than those without
    han = lambda i: F.substring("after", i, 1)
    x = around.where(han(1).isin(*first)).withColumns({"x": han(2), "y": han(3), "r1": _right(F.expr("substring(after, 2)")), "r2": _right(F.expr("substring(after, 3)"))})
    ends = x.where(F.col("x").rlike(_HAN) & ~F.col("x").isin(*first))
    ends = ends.join(p.select("l", F.col("r").alias("r1"), F.col("n").alias("without")), ["l", "r1"], "left").join(p.select("l", F.col("r").alias("r2"), F.col("n").alias("n2")), ["l", "r2"], "left")
    votes = ends.select("x", (F.coalesce("n2", F.lit(0)) > F.coalesce("without", F.lit(0))).cast("double").alias("vote"))
    # a word after names follows those of two characters as well
    votes = votes.unionAll(x.where(F.col("x").isin(*first)).select("y", F.lit(0.0)))
    more = votes.groupBy("x").agg(F.avg("vote").alias("score")).where(F.col("score") > ACCEPT).select("x").collect()
    return first, "".join(sorted({*first, *(r.x for r in more)}))


class GivenNames:
    """Windows of one Chinese character before one or two characters of given names, as far right as they go."""

    def __init__(self, first: str, second: str) -> None:
        self.first, self.second = re.compile(f"[{first}]"), frozenset(second)

    def windows(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.first.finditer(text):
            s, e = m.start() - 1, m.end()
            if s >= 0 and "一" <= text[s] <= "鿿":
                yield s, e + (e < len(text) and text[e] in self.second)


def chinese_names(text: str, given: GivenNames, patterns: frozenset[tuple[str, str]], surnames: frozenset[str]) -> list[tuple[int, int, str, str, int]]:
    """(start, end, surname, pattern, known) of spans a pattern or a seed surname holds."""
    out = []
    for s, e in given.windows(text):
        p = (_edge(text[max(0, s - 4) : s], -1), _edge(text[e : e + 6], 1))
        known = text[s] in surnames
        if known or p in patterns:
            out.append((s, e, text[s], f"zh {p[0]}|{p[1]}", int(known)))
    return out


def _windows(first: str, second: str, patterns: frozenset[tuple[str, str]]):
    """(surname, pattern or null, the text around) of windows of one character and given-name characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = GivenNames(first, second)
        for b in batches:
            seen: set[tuple[str, str | None, str]] = set()
            for text in b.column("text").to_pylist():
                end = -1
                for s, e in given.windows(text):
                    if s < end:
                        continue
                    p = (_edge(text[max(0, s - 4) : s], -1), _edge(text[e : e + 6], 1))
                    hit = p in patterns
                    end = e if hit else end
                    seen.add((text[s], f"{p[0]}|{p[1]}" if hit else None, text[max(0, s - 4) : e + 6]))
            cols = list(zip(*seen, strict=True)) if seen else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in cols], ["c", "p", "w"])

    return run


# ---- passes -----------------------------------------------------------------

_PROPOSED = "doc_id bigint, kind string, value string, sure boolean, key string, seed int, patterns array<string>, at array<int>"


def _propose(words: Words, surnames: frozenset[str], first: str, second: str, patterns: frozenset[tuple[str, str]]):
    given = GivenNames(first, second) if first else None

    def of(text: str) -> list[list]:
        # sure, key, seed (0: unknown, 1: a part is known, 2: all are), patterns, places
        found: dict[tuple[str, str], list] = {}
        taken = bytearray(len(text))
        places: set[int] = set()

        def offer(kind: str, a: int, b: int, sure: bool, key: str | None, seed: int, patterns: list[str], take: bool = True) -> None:
            old = found.setdefault((kind, text[a:b]), [sure, key, 0, [], []])
            old[2] = max(old[2], seed)
            old[3] += patterns
            old[4].append(a)
            if take:
                taken[a:b] = b"\x01" * (b - a)

        free = lambda a, b: taken.find(1, a, b) < 0
        for a, b in emails(text):
            offer("email", a, b, True, None, 0, [])
        for kind, a, b in numbers(text):
            if free(a, b):
                offer(kind, a, b, True, None, 0, [])
        for a, b in (*roads(text), *(m.span() for m in _STRASSE.finditer(text))):
            if free(a, b):
                offer("address", a, b, True, None, 0, [])
        for m in _STREET.finditer(text):
            town = _TOWN.match(text, m.end())
            if town:
                places.add(town.start(1))
            offer("address", *m.span(), False, "a " + m[1].lower(), 2 if town else 0, ["a" + x for x in contexts(text, *m.span())])
        for s, e, key, n in latin_names(text, words, places):
            if free(s, e):
                kind_of = "c" if text[s:e].isupper() else "n"  # capitals have patterns of their own
                offer("name", s, e, False, "n " + key, min(2, n) if n < 2 or n >= len(key.split()) else 1, [kind_of + x for x in contexts(text, s, e)], False)
        if given:
            end = -1
            for s, e, key, p, n in chinese_names(text, given, patterns, surnames):
                if s >= end:
                    end = e
                    if free(s, e):
                        offer("name", s, e, False, "z " + key, 2 * n, [p], False)
        return [[k, v, *x] for (k, v), x in found.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())]
        for b in batches:
            rows = [(d, *x) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for x in of(t)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "kind", "value", "sure", "key", "seed", "patterns", "at"])

    return run


def scored(proposed: DataFrame) -> DataFrame:
    """(pattern, score): the bipartite graph of patterns and instances, scored in rounds."""
    edges = proposed.where("not sure").select("key", "seed", F.explode(F.array_distinct("patterns")).alias("pattern"))
    edges = cut(edges.groupBy("key", "pattern").agg((F.max("seed") > 0).alias("seed")))
    worth = edges.groupBy("key").agg(F.max("seed").cast("double").alias("worth"))
    # a key or a pattern may hold a third of all edges; which ones are hot is the same in all rounds
    hot_key, hot_pattern = (hot_rows(edges, [c]) for c in ("key", "pattern"))
    for i in range(ROUNDS):
        held = salted_join(edges, worth, ["key"], F.xxhash64("pattern"), rows=hot_key)
        score = held.groupBy("pattern").agg(F.avg("worth").alias("score"), F.count("*").alias("n"))
        # a Chinese pattern holds few surnames; one with a seed among them counts
        score = score.where((F.col("n") >= SUPPORT) | F.col("pattern").startswith("zh ")).select("pattern", "score")
        if i == ROUNDS - 1:
            return cut(score)
        best = salted_join(edges, score, ["pattern"], F.xxhash64("key"), rows=hot_pattern).groupBy("key").agg(F.max("score").alias("best"))
        worth = worth.join(best, "key", "left").select("key", F.greatest("worth", F.coalesce("best", F.lit(0.0))).alias("worth"))
        worth = cut(worth)
    return score


def _learned(docs: DataFrame, seeds: DataFrame) -> tuple[DataFrame, Words, frozenset[str], str, str, frozenset[tuple[str, str]]]:
    """What the passes before the last one learn: words, surnames, characters of given names, patterns."""
    d = spread(docs.where("length(text) > 0").select("doc_id", "text"), "doc_id")
    rows = seeds.where("name_part is not null").select("name_part", "name_kind").distinct().limit(MAX_SEEDS + 1).collect()
    if len(rows) > MAX_SEEDS:
        raise ValueError(f"more than {MAX_SEEDS} name parts; seeds are shipped to every task and must be a short list")
    known = frozenset(p for r in rows for p in part_key(r.name_part))
    surnames = frozenset(r.name_part for r in rows if r.name_kind == "family" and re.fullmatch(_HAN, r.name_part))

    evidence = cut(d.select("text").mapInArrow(_evidence(surnames, known), "k string, c string, l string, after string").distinct())
    words = Words(known, *learned_words(evidence))
    around = evidence.where("k = 'z'").select("c", "l", "after")
    first, second = given_names(around)
    patterns: frozenset[tuple[str, str]] = frozenset()
    if first:
        pairs = _patterns(around, first, second).select("l", "r").limit(MAX_PATTERNS + 1).collect()
        if len(pairs) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} patterns of Chinese names; they are shipped to every task and must be few")
        patterns = frozenset((r.l, r.r) for r in pairs)

    if patterns:
        # a surname no seed knows: most of its windows stand in patterns, and in several of them; at most all characters there are
        seen = d.select("text").where(F.col("text").rlike(_HAN)).mapInArrow(_windows(first, second, patterns), "c string, p string, w string").distinct()
        seen = seen.groupBy("c").agg(F.count("*").alias("all"), F.count("p").alias("hit"), F.count_distinct("p").alias("kinds"))
        surnames |= {r.c for r in seen.where((F.col("kinds") >= SUPPORT) & (F.col("hit") >= ACCEPT * F.col("all"))).select("c").collect()}
    return d, words, surnames, first, second, patterns


def spans(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, kind, value, at, how): values of each document with their places; how: shape, pattern or seed."""
    d, *learned = _learned(docs, seeds)
    proposed = cut(d.mapInArrow(_propose(*learned), _PROPOSED))
    score = scored(proposed)
    sure = proposed.where("sure").select("doc_id", "kind", "value", "at", F.lit("shape").alias("how"))
    rest = proposed.where("not sure").withColumn("row", F.xxhash64("doc_id", "kind", "value"))
    # words in capitals are often no names: their patterns need a higher score
    enough = F.when(F.col("pattern").startswith("c"), ACCEPT_CAPITALS).otherwise(ACCEPT)
    held = salted_join(rest.select("row", F.explode(F.array_distinct("patterns")).alias("pattern")), score, ["pattern"], F.xxhash64("row"))
    held = held.groupBy("row").agg(F.max("score").alias("best"), F.max((F.col("score") >= enough).cast("int")).alias("good"))
    j = rest.join(held, "row", "left")
    # a name of which one part is known stands unless all its patterns speak against it
    how = F.when(F.col("good") == 1, "pattern").when(F.col("seed") == 2, "seed").when((F.col("seed") == 1) & (F.coalesce("best", F.lit(1.0)) >= REJECT), "seed")
    open_ = j.withColumn("how", how).where("how is not null").select("doc_id", "kind", "value", "at", "how")
    return sure.unionAll(open_)


def found(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, kind, found_value), distinct."""
    return spans(docs, seeds).select("doc_id", "kind", F.col("value").alias("found_value")).distinct()


def redacted(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, text) of every row, what was found replaced at its places by <EMAIL>, <PHONE>, <ID_NUMBER>, <ADDRESS> or <NAME>.

    Where two spans overlap the earlier one counts, of two that begin together the longer.
    Documents of one id are taken apart by their texts, as their places differ.
    """
    d = docs.select("doc_id", "text").withColumn("__doc", F.xxhash64("doc_id", "text"))
    once = d.where("length(text) > 0").select(F.col("__doc").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    hits = spans(once, seeds).select(F.col("doc_id").alias("__doc"), "kind", F.length("value").alias("n"), F.explode("at").alias("at"))
    per = hits.groupBy("__doc").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "kind"))).alias("hits"))
    both = d.join(per, "__doc", "left").select("doc_id", "text", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, hits in zip(b.column("text").to_pylist(), b.column("hits").to_pylist(), strict=True):
                if t and hits:
                    parts, end = [], 0
                    for h in hits:
                        if h["at"] >= end:
                            parts += [t[end : h["at"]], f"<{h['kind'].upper()}>"]
                            end = h["at"] - h["less"]
                    t = "".join([*parts, t[end:]])
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return both.mapInArrow(run, "doc_id bigint, text string")
