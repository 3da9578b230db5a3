"""Personal information in free text: candidate spans, boosted trees, calibrated thresholds (problem 10)."""

from __future__ import annotations

import base64
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.boost import Boosted
from kinweave.llm.pii_sample import MAKERS, labelled_texts
from kinweave.operators.skew import salted_join
from kinweave.session import BROADCAST_BYTES, cut, drop_cut

KINDS = ("name", "email", "phone", "address", "id_number")
#: Public vocabularies whose whole lower-case words are held to be ordinary; any files of this form (ranks) may be named instead.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: What is left in a text does more harm than a needless placeholder: thresholds weigh recall this many times as much as precision.
RECALL_WEIGHT = 1.0
#: Characters without width may stand anywhere; they are passed over in matching and kept in spans.
_UNSEEN = re.compile("[​‌‍⁠﻿­]")
_S = r"(?:[ \u00a0\u202f\t]+)"
_L = r"[^\W\d_]"  # a letter
_LX = r"(?:[^\W\d_]|&\w{2,6};|[\u0080-\u009f¡-¿\u0192\u02c6\u02dc\u2020-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122])"  # also entities and what is left of letters read in a wrong encoding


def _address_patterns() -> list[str]:
    word = rf"(?:[A-ZÀ-ÖØ-Þ]|&[A-Z]\w{{1,5}};|{_LX}){_LX}*(?:[’'\-]{_LX}+)*"
    en = rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite){_S}\d+\w?,{_S})?\d{{1,5}}[a-z]?{_S}(?:{word}{_S}){{1,3}}(?:Street|Lane|Road|Rd|Avenue|Ave|Close|Drive|Way|Court|Terrace|Place|St)\b(?:,?{_S}(?:Flat|Apt\.?|Apartment|Unit|Floor|Suite|#){_S}?\d+\w?)?"
    unit = rf"(?:,{_S}(?:\d+\.{_S}?(?:Stock|OG|Etage)|(?:Whg|Wohnung|Top|App)\.?{_S}\d+\w?|Hinterhaus))?"
    de = rf"(?:(?:Alte[rsnm]?|Am|An der|Neue[rsnm]?|Obere[rsn]?|Untere[rsn]?|Große|Kleine){_S})?{word}(?:{_S}|-)?(?:straße|stra&szlig;e|straÃ.e|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring|berg|steig|graben){_S}\d{{1,4}}(?:{_S}?[a-z])?\b{unit}"
    floor = rf"(?:,{_S}(?:appt?\.?|appartement|b[âa]t\.?|escalier|\d+(?:er|e|ème)?){_S}(?:\d+|[A-Z]\b|(?:é|&eacute;)tage)(?:{_S}\w\b)?)?"
    fr = rf"\d{{1,4}}(?:{_S}(?:bis|ter))?,?{_S}(?:rue|avenue|av\.|bd|boulevard|all(?:é|&eacute;|Ã.)e|place|chemin|impasse|quai|cours|route){_S}(?:(?:de{_S}la|des|du|de|de{_S}l[’'])(?:{_S}|(?<=[’'])))?(?:d[’'])?{word}{floor}"
    door = rf"(?:,{_S}\d{{1,3}}(?:º|ª|°|&ordm;|Âº)(?:{_S}?(?-i:[A-Z])\b|{_S}?izq\w*|{_S}?dcha\w*)?)?"
    es = rf"(?:C/|Calle|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Camino|Ronda){_S}?(?:(?:de{_S}la|de{_S}los|de{_S}las|del|de|los|las|la|el){_S})?{word}(?:{_S}{word})??,?{_S}\d{{1,4}}\w?\b{door}"
    return [en, de, fr, es]


_ADDRESS = [re.compile(p, re.I) for p in _address_patterns()]
#: What any match of the pattern of the same place contains; looked for first, as it is found much faster.
_ADDRESS_HINTS = [
    re.compile(p, re.I)
    for p in (
        r"\b(?:Street|Lane|Road|Rd|Avenue|Ave|Close|Drive|Way|Court|Terrace|Place|St)\b",
        rf"(?:stra\S{{1,7}}e|str\.|gasse|weg|platz|allee|ufer|damm|ring|berg|steig|graben){_S}\d",
        rf"\d(?:{_S}(?:bis|ter))?,?{_S}(?:rue|av|bd|boulevard|all|place|chemin|impasse|quai|cours|route)",
        r"C/|Calle|Avenida|Avda|Av\.|Plaza|Pza|Paseo|Camino|Ronda",
    )
]
_LOCAL, _HOST = r"[\w+\-]+", r"[\w\-]+"
_AT = r"\s?[\[({](?:at|arroba|chez)[\])}]\s?"
_DOT = r"(?:\.|\s?[\[({](?:dot|punto|punkt|point)[\])}]\s?)"
_SAID = rf"{_S}(?:dot|punto|punkt|point){_S}"
#: with its sign, with bracketed signs, with signs spelled out as words
_EMAILS = [
    re.compile(p, re.I)
    for p in (
        rf"{_LOCAL}(?:\.{_LOCAL})*@{_HOST}(?:\.{_HOST})+",
        rf"{_LOCAL}(?:{_DOT}{_LOCAL})*{_AT}{_HOST}(?:{_DOT}{_HOST})+",
        rf"{_LOCAL}(?:\.{_LOCAL}|{_SAID}{_LOCAL})*{_S}(?:at|arroba){_S}{_HOST}(?:{_SAID}{_HOST})+",
        rf"{_LOCAL}(?:\.{_LOCAL})*{_S}(?:at|arroba){_S}{_HOST}(?:{_SAID}{_HOST})+",
        rf"{_LOCAL}(?:\.{_LOCAL})*\s@\s{_HOST}(?:\s?\.\s?{_HOST})+",
    )
]
_EMAIL_HINTS = [re.compile(p, re.I) for p in ("@", r"[\[({](?:at|arroba|chez)[\])}]", rf"{_S}(?:at|arroba){_S}{_HOST}{_SAID}", rf"{_S}(?:at|arroba){_S}{_HOST}{_SAID}", r"\s@\s")]
_PHONE = re.compile(rf"(?<![\w@.\-/+])(?:\+|\((?=\d{{2,5}}\)))?\d(?:{_S}|[().\-/\d]){{5,24}}\d(?![\w@])(?![.\-/]\d)")
#: the same where more digits follow a number that is complete
_PHONE_TIGHT = re.compile(rf"(?<![\w@.\-/+])(?:(?:\+|00)\d{{1,3}}{_S})?(?:\(\d{{3}}\){_S}?|\d{{3}}[.\- ])\d{{3}}[.\- ]\d{{4}}(?![\w.\-])")
_ID = [
    re.compile(p, re.I)
    for p in (
        rf"(?<![\w.\-/])\d{{3}}(?:{_S}|-)?\d{{2}}(?:{_S}|-)?\d{{4}}(?![\w\-/])",
        r"(?<![\w.\-/])[A-Z]{1,3}\d{6,9}(?![\w\-/])",
        r"(?<![\w.\-/])\d{2}[A-Z]{2}\d{5}(?![\w\-/])",
        rf"(?<![\w.\-/])[A-Z]\d[A-Z0-9]{{2}}(?:{_S})?\d{{4}}(?:{_S})?\d[A-Z]?(?![\w\-/])",
        r"(?<![\w.\-/])\d{2}[- ]\d{6}[- ][A-Z][- ]\d{3}(?![\w\-/])",
        r"(?<![\w.\-/])\d{2}[. ]?\d{3}[. ]?\d{3}[- ]?[A-ZÑ](?![\w\-/])",
        r"(?<![\w.\-/])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?![\w\-/])",
        rf"(?<![\w.\-/])[1-478](?:{_S})?\d{{2}}(?:{_S})?\d{{2}}(?:{_S})?\d{{2}}(?:{_S})?\d{{3}}(?:{_S})?\d{{3}}(?:(?:{_S})?\d{{2}})?(?![\w\-/])",
        r"(?<![\w.\-/])[A-Z]-?\d{7,8}-?[A-Z](?![\w\-/])",
        r"(?<![\w.\-/])(?=[A-Z0-9]*\d{3})[A-Z0-9]{7,16}(?![\w\-/])",
    )
]
@dataclass
class Words:
    """How the words of a collection are written: ``counts`` maps lower-cased words to the number of their places inside a sentence, and of those where
    they stand in lower case. Two places more are added to each: in lower case for words that a public vocabulary has in lower case.
    ``fixed`` maps pairs of capitalised words that recur to the share of the first word's pairs that this one makes up.

    Of more words than a broadcast may hold, ``counts`` has the known ones that are not ordinary, and ``tables`` the others that are (k) and the fixed
    pairs (x, s); each batch of documents gets those that its texts ask for, as ``lower`` and ``fixed``, so the answers are the same."""

    counts: dict[str, tuple[int, int]]
    known: frozenset[str] = frozenset()
    fixed: dict[str, float] = field(default_factory=dict)
    lower: frozenset[str] = frozenset()
    tables: tuple[DataFrame, DataFrame] | None = None

    def ordinary(self, word: str) -> bool:
        n, low = self.counts.get(word, (0, 0))
        return word in self.lower or low + 2 * (word in self.known) >= ORDINARY * (n + 2)

    @classmethod
    def of(cls, texts: list[str], known: frozenset[str], least: int = 2) -> Words:
        every, low = Counter(), Counter()
        for t in texts:
            for w in regex.findall(_INNER_WORD, t):
                every[w.lower()] += 1
                low[w.lower()] += w.islower()
        pairs = Counter(x.lower() for t in texts for x in regex.findall(_CAPITAL_PAIR, t))
        first = Counter()
        for x, n in pairs.items():
            first[x.split(" ")[0]] += n
        return cls({w: (n, low[w]) for w, n in every.items() if n >= least}, known, {x: n / first[x.split(" ")[0]] for x, n in pairs.items() if n >= RECURS})


#: Pairs of capitalised words are held to recur from this number on.
RECURS = 5
_CAPITAL_PAIR = r"\p{Lu}\p{L}+ \p{Lu}\p{L}+"
#: From this share in lower case on a word is an ordinary one.
ORDINARY = 0.6
#: Bytes held for a word or pair of a collection, for the size of a broadcast.
_WORD_BYTES = 64
#: A word after another word or a comma, not the first of a sentence.
_INNER_WORD = r"(?<=[\p{L}\p{N},] )\p{L}{3,}"


def words_of(docs: DataFrame, known: frozenset[str], least: int = 2, limit: int = BROADCAST_BYTES) -> Words:
    """``Words`` of all texts of docs(text), counted across the cluster: all that occur ``least`` times, however many.

    If words and pairs need more than ``limit`` bytes they stay tables, which ``find`` and ``redact`` join to the documents. Only words that are not
    what their absence would mean go along: known words that are not ordinary (no more than there are known words) and unknown ones that are.
    """
    spark = docs.sparkSession
    w = docs.select(F.explode(F.regexp_extract_all("text", F.lit(_INNER_WORD), F.lit(0))).alias("w"))
    per = w.groupBy("w").agg(F.count("*").alias("n")).groupBy(F.lower("w").alias("k")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("w") == F.lower("w"), F.col("n")).otherwise(F.lit(0))).alias("low"))
    per = cut(per)
    kept = per.where(F.col("n") >= least)
    x = docs.select(F.explode(F.regexp_extract_all("text", F.lit(_CAPITAL_PAIR), F.lit(0))).alias("x")).groupBy(F.lower("x").alias("x")).agg(F.count("*").alias("n"))
    pairs = cut(x.withColumn("a", F.substring_index("x", " ", 1)))
    often = pairs.where(F.col("n") >= RECURS)
    first = pairs.join(often.select("a").distinct(), "a", "left_semi").groupBy("a").agg(F.sum("n").alias("of"))
    fixed = often.join(first, "a").select("x", (F.col("n") / F.col("of")).alias("s"))
    most = limit // _WORD_BYTES
    if kept.select("k").union(often.select("x")).limit(most + 1).count() <= most:
        every, fixed = kept.toPandas(), fixed.toPandas()
        drop_cut(per, pairs)
        return Words(dict(zip(every["k"], zip(every["n"].tolist(), every["low"].tolist()))), known, dict(zip(fixed["x"], fixed["s"])))
    enough = F.lit(ORDINARY) * (F.col("n") + 2)
    listed = spark.createDataFrame([(k,) for k in sorted(known)], "k string")
    odd = kept.where(F.col("low") + 2 < enough).join(F.broadcast(listed), "k", "left_semi").toPandas()
    tables = cut(kept.where(F.col("low") >= enough).select("k")), cut(fixed)
    drop_cut(per, pairs)
    return Words(dict(zip(odd["k"], zip(odd["n"].tolist(), odd["low"].tolist()))), known, tables=tables)


_WORDS = re.compile(rf"(?<![\w&]){_LX}+(?:[’'\-]{_LX}+)*")
_GAP, _COMMA, _INITIAL = re.compile(rf"{_S}\Z"), re.compile(rf",{_S}\Z"), re.compile(rf"\.{_S}?\Z")


def _names(text: str, words_of: Words) -> Iterator[tuple[int, int, int]]:
    """(start, end, generator): two neighbouring words, in either order and with or without an initial between or before them, that are both
    capitalised (60), both not ordinary words (61), or all of their line (62)."""
    words = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
    capital = [text[a].isupper() or text[a] == "&" for a, _ in words]
    rare: dict[int, bool] = {}

    def is_rare(k: int) -> bool:
        if k not in rare:
            a, b = words[k]
            rare[k] = b - a > 2 and not words_of.ordinary(text[a:b].lower())
        return rare[k]

    gap = [text[x[1] : y[0]] for x, y in zip(words, words[1:])]
    space, comma = [g == " " or bool(_GAP.match(g)) for g in gap], [g[:1] == "," and bool(_COMMA.match(g)) for g in gap]
    dot = [c and w[1] - w[0] == 1 and bool(_INITIAL.match(g)) for w, c, g in zip(words, capital, gap)]
    for i in range(len(gap)):
        ends: list[tuple[int, int]] = []  # last word, and end of the span
        if dot[i]:  # X. Family
            ends.append((i + 1, words[i + 1][1]))
        elif space[i] or comma[i]:
            if words[i][1] - words[i][0] > 1:
                if words[i + 1][1] - words[i + 1][0] > 1:  # Given Family, Family, Given
                    ends.append((i + 1, words[i + 1][1]))
                if space[i] and i + 1 < len(dot) and dot[i + 1]:  # Given X. Family
                    ends.append((i + 2, words[i + 2][1]))
                if comma[i] and i + 1 < len(space) and space[i + 1] and i + 2 < len(words) and words[i + 2][1] - words[i + 2][0] == 1 and capital[i + 2] and text[words[i + 2][1] : words[i + 2][1] + 1] == ".":  # Family, Given X.
                    ends.append((i + 1, words[i + 2][1] + 1))
        for j, end in ends:
            start = words[i][0]
            if capital[i] and capital[j]:
                yield start, end, 60
            elif (dot[i] or is_rare(i)) and is_rare(j):
                yield start, end, 61
            elif not text[text.rfind("\n", 0, start) + 1 : start].strip(" \t—–->*") and not text[end : (text.find("\n", end) + 1 or len(text) + 1) - 1].strip():
                yield start, end, 62


def written_forms(text: str) -> list[tuple[int, int, str, int]]:
    """The candidates of all kinds but names, for which no words are looked up."""
    out: dict[tuple[int, int, str], int] = {}

    def add(a: int, b: int, kind: str, gen: int) -> None:
        if b > a:
            out.setdefault((a, b, kind), gen)

    for g, p in enumerate(_EMAILS):
        if _EMAIL_HINTS[g].search(text):
            for m in p.finditer(text):
                add(*m.span(), "email", g)
    if _DIGITS.search(text):
        for g, p in enumerate(_ADDRESS):
            for m in p.finditer(text) if _ADDRESS_HINTS[g].search(text) else ():
                add(*m.span(), "address", 10 + g)
                head = re.match(r"[^,]*,\s\d+\w?\s.*?(?=,)|[^,]*", m.group())
                if head and len(head.group()) < len(m.group()):
                    add(m.start(), m.start() + len(head.group()), "address", 20 + g)
        for m in _PHONE_TIGHT.finditer(text):
            add(*m.span(), "phone", 31)
        for m in _PHONE.finditer(text):
            digits = sum(c.isdigit() for c in m.group())
            if 7 <= digits <= 15:
                add(*m.span(), "phone", 30)
        for g, p in enumerate(_ID):
            for m in p.finditer(text):
                add(*m.span(), "id_number", 40 + g)
    return [(a, b, k, g) for (a, b, k), g in out.items()]


def candidates(text: str, words_of: Words, forms: list[tuple[int, int, str, int]] | None = None) -> list[tuple[int, int, str, int]]:
    """Overlapping (start, end, kind, generator) proposals; deliberately too many. ``forms``: the text's ``written_forms``, if they are there already."""
    return [*(written_forms(text) if forms is None else forms), *((a, b, "name", g) for a, b, g in _names(text, words_of))]


_DIGITS = re.compile(r"\d")
_TOKEN = re.compile(rf"{_LX}+|\d+|[^\s\w]")


def _norm(t: str) -> str:
    return "#" * min(len(t), 4) if t.isdigit() else t.lower()


@lru_cache(maxsize=1 << 16)
def _stem(w: str) -> str:
    """The first letters of a word without accents, which related words of several languages share."""
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))[:4]


@dataclass
class Cues:
    """Log odds of words before, after and inside the spans of a kind, counted on one part of the labelled sample."""

    odds: dict[tuple[str, str, str], float] = field(default_factory=dict)

    @staticmethod
    def context(text: str, a: int, b: int) -> tuple[dict[str, str], list[str]]:
        left = [_norm(t) for t in _TOKEN.findall(text[max(0, a - 60) : a])]
        right = [_norm(t) for t in _TOKEN.findall(text[b : b + 40])]
        lw, rw = [t for t in left if t[0].isalpha()], [t for t in right if t[0].isalpha()]
        get = lambda s, i: s[i] if len(s) > (i if i >= 0 else -i - 1) else "^"
        slots = {"l1": get(left, -1), "lw": get(lw, -1), "l2": " ".join(lw[-2:]) or "^", "r1": get(right, 0), "rw": get(rw, 0), "r2": " ".join(rw[:2]) or "^"}
        return slots, [_stem(w) for w in lw[-5:]]

    @staticmethod
    def inside(span: str) -> list[str]:
        return [t.lower() for t in re.findall(rf"{_LX}{{2,}}", span)]

    def fit(self, rows: list[tuple[str, int, int, str, bool]]) -> Cues:
        """Counts contexts, not places: a word met again and again in one and the same phrase counts once."""
        yes, no = defaultdict(set), defaultdict(set)
        for text, a, b, kind, good in rows:
            into = yes if good else no
            slots, stems = self.context(text, a, b)
            where = slots["l2"], slots["r1"]
            for slot, w in slots.items():
                into[kind, slot, w].add(where)
            for w in set(stems):
                into[kind, "near", w].add(where)
            inner = self.inside(text[a:b])
            for w in set(inner):
                into[kind, "in", w].add(where)
        total = {k: (sum(len(v) for (c, *_), v in yes.items() if c == k) + 1) / (sum(len(v) for (c, *_), v in no.items() if c == k) + 1) for k in KINDS}
        self.odds = {k: math.log((len(yes[k]) + 0.5) / (len(no[k]) + 0.5 / total[k[0]])) - 0.5 * math.log(total[k[0]]) for k in {*yes, *no}}
        # any word may stand before or after a name: its neighbours speak for one, or say nothing
        self.odds = {k: v for k, v in self.odds.items() if v > 0 or k[0] != "name" or k[1] == "in"}
        return self


def features(text: str, cand: tuple[int, int, str, int], cues: Cues, words_of: Words, brands: frozenset[str] = frozenset()) -> list[float]:
    a, b, kind, gen = cand
    s = text[a:b]
    digits, letters, upper = sum(map(str.isdigit, s)), sum(map(str.isalpha, s)), sum(map(str.isupper, s))
    groups = re.findall(r"\d+", s)
    slots, stems = Cues.context(text, a, b)
    odds = cues.odds.get
    inner = Cues.inside(s)
    ins = [odds((kind, "in", w), 0.0) for w in inner] or [0.0]
    near = [odds((kind, "near", w), 0.0) for w in stems] or [0.0]
    words = s.split()
    line_a, line_b = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    before, after = text[line_a:a].strip(), text[b : line_b if line_b >= 0 else len(text)].strip()
    first, last = text[max(0, a - 1) : a] or " ", text[b : b + 1] or " "
    around = text[max(0, a - 100) : b + 100]
    share_up = sum(map(str.isupper, around)) / max(1, sum(map(str.isalpha, around)))
    title = sum(w[:1].isupper() and w[1:2].islower() for w in words)
    low = [words_of.ordinary(w) for w in inner] or [False]
    branded = [w in brands for w in inner] or [False]
    return [
        gen, len(s), digits, letters, upper / max(1, letters), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        s[0] == "+", s[0] == "(" or s[:2] == "00", s.count("-"), s.count("."), s.count("/"), s.count(" "), s.count(","), s[0].isalpha(), s[-1].isalpha(),
        *(odds((kind, k, v), 0.0) for k, v in slots.items()), min(ins), max(ins), sum(ins), max(near), min(near), sum(near), not before, not after, not text[:a].strip() and not text[b:].strip(),
        first in "([", last in ")]", first == "@", not after and not text[b:].strip(), before[-1:] in ".!?>;)", before[-1:] in ":,—–-", after[:1] in ",.;", after[:1].isupper(),
        len(words), title, share_up, bool(re.search(r"\b[A-Z]\.", s)), s.isupper(), s.islower(), bool(re.search(r"[@\[(]", s)), sum(map(str.isdigit, text[b : b + 5])),
        words_of.fixed.get(s.lower(), 0.0), low[0], low[-1], max(low), sum(low) / len(low), sum(branded), branded[0], branded[-1], min(map(len, inner), default=0), max(map(len, inner), default=0),
    ]


@dataclass
class Detector:
    """``brands``: lower-cased words of brands; ``words``: how words are written elsewhere. Both are features, neither decides."""

    cues: Cues
    models: dict[str, Boosted]
    brands: frozenset[str] = frozenset()
    words: Words = field(default_factory=lambda: Words({}))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Chosen spans (start, end, kind) of the original text, not overlapping, in order."""
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str], forms: list[list[tuple[int, int, str, int]]] | None = None) -> list[list[tuple[int, int, str]]]:
        """``spans`` of many texts; the trees score all their candidates of a kind at once. ``forms``: each text's, as ``asked`` gives them."""
        plain = [_UNSEEN.sub("", t) for t in texts]
        own: dict[str, list[tuple[int, tuple[int, int, str, int]]]] = {k: [] for k in KINDS}
        for i, t in enumerate(plain):
            for c in candidates(t, self.words, forms[i] if forms else None):
                own[c[2]].append((i, c))
        scored: list[list[tuple[float, tuple[int, int, str, int]]]] = [[] for _ in texts]
        for kind, rows in own.items():
            if rows:
                m = self.models[kind]
                p = m.score(np.array([features(plain[i], c, self.cues, self.words, self.brands) for i, c in rows], dtype=float))
                for s, (i, c) in zip(p, rows):
                    if s >= m.threshold:
                        scored[i].append((float((s - m.threshold) / (1 - m.threshold)), c))
        return [self._choose(t, len(t) != len(q), s) for t, q, s in zip(texts, plain, scored)]

    def asked(self, text: str) -> tuple[list[tuple[int, int, str, int]], list[str], list[str]]:
        """Written forms of a text, and all unknown words and pairs of words on which its ``spans_of`` may depend. Words that turn out to be
        ordinary can only make candidates fewer, so the words of those that there are without them are all."""
        t = _UNSEEN.sub("", text)
        forms = written_forms(t)
        spans = {t[c[0] : c[1]] for c in candidates(t, self.words, forms)}
        words = {w for x in spans for w in (*Cues.inside(x), *(y.lower() for y in _WORDS.findall(x)))}
        return forms, sorted(w for w in words if len(w) > 2 and w not in self.words.known), sorted({x.lower() for x in spans if x.count(" ") == 1})

    @staticmethod
    def _choose(text: str, unseen: bool, scored: list) -> list[tuple[int, int, str]]:
        scored.sort(key=lambda x: (-round(x[0], 3), x[1][0] - x[1][1], x[1]))
        taken: list[tuple[int, int, str]] = []
        for _, (a, b, kind, _g) in scored:
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))
        if unseen and taken:
            keep = [i for i in range(len(text)) if not _UNSEEN.match(text[i])]
            taken = [(keep[a], keep[b - 1] + 1, k) for a, b, k in taken]
        return sorted(taken)


def vocabulary_words(paths: tuple[str, ...] = VOCABULARIES) -> frozenset[str]:
    """Lower-cased words of three letters or more that are single tokens, with the space before them, of any of the vocabularies."""
    out = set()
    for path in paths:
        with open(path, "rb") as f:
            for line in f:
                word = base64.b64decode(line.split()[0]).decode("utf-8", "ignore") if line.strip() else ""
                if len(word) > 3 and word[0] == " " and word[1:].isalpha() and word.islower():
                    out.add(word[1:])
    return frozenset(out)


def train(sample: int = 12000, seed: int = 3, brands: frozenset[str] = frozenset(), vocabularies: tuple[str, ...] = VOCABULARIES) -> Detector:
    """Fits on ``sample`` generated labelled texts: one third for the cue words, one for the trees, one held out for calibration.

    Each third has carriers that the others have not, so trees and thresholds are fitted to contexts of which the cue words know only a part;
    of every other row all cue words are withheld, as in a text whose words were never met.
    """
    known = vocabulary_words(vocabularies)
    parts = [labelled_texts(sample // 3, seed + i, i, 3) for i in range(3)]
    words = Words.of([t for part in parts for t, _ in part], known)

    def rows(part):
        for text, spans in part:
            truth = {(a, b, k) for a, b, k in spans}
            for c in candidates(text, words):
                yield text, c, (c[0], c[1], c[2]) in truth

    spans = lambda part: [(t, c[0], c[1], c[2], good) for t, c, good in rows(part)]
    cues = Cues().fit(spans(parts[0]))
    data = []
    for part in parts[1:]:
        by: dict[str, tuple[list, list]] = {k: ([], []) for k in KINDS}
        for i, (t, c, good) in enumerate(rows(part)):
            by[c[2]][0].append(features(t, c, cues if i % 2 else Cues(), words, MAKERS))
            by[c[2]][1].append(good)
        data.append({k: (np.array(x, dtype=float), np.array(y, dtype=float)) for k, (x, y) in by.items()})
    models = {k: Boosted().fit(*data[0][k]).calibrate(*data[1][k], beta=RECALL_WEIGHT) for k in KINDS}
    every = Cues().fit([x for part in parts for x in spans(part)])  # the trees are done; now the words of all carriers may help
    return Detector(every, models, brands, Words({}, known))


_trained: dict[tuple, Detector] = {}


def detector(docs: DataFrame | None = None, sample: int = 12000, seed: int = 3, brands: frozenset[str] = frozenset()) -> Detector:
    """The trained detector, fitted once per session, with the brands given and the words of ``docs`` (text) counted over all of them."""
    key = (sample, seed)
    if key not in _trained:
        _trained[key] = train(sample, seed)
    d = replace(_trained[key], brands=brands)
    return d if docs is None else replace(d, words=words_of(docs, d.words.known))


def _prepared(docs: DataFrame, d: Detector) -> tuple[DataFrame, Callable[[pd.DataFrame], list[list[tuple[int, int, str]]]]]:
    """docs (doc_id, text) with what the detector's tables of words hold for each text, and a function from batches of these rows to their spans."""
    docs, tables = docs.select("doc_id", "text"), d.words.tables
    shared = docs.sparkSession.sparkContext.broadcast(replace(d, words=replace(d.words, tables=None)))
    if tables is None:
        return docs, lambda b: shared.value.spans_of([t or "" for t in b["text"]])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [shared.value.asked(t or "") for t in b.column("text").to_pylist()]
            forms = [[v for x, y, k, g in f for v in (x, y, KINDS.index(k), g)] for f, _, _ in rows]
            words, pairs = [w for _, w, _ in rows], [p for _, _, p in rows]
            more = pa.array(forms, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.string())), pa.array(pairs, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), *more], ["doc_id", "text", "forms", "words", "pairs"])

    asked = docs.mapInArrow(ask, "doc_id bigint, text string, forms array<int>, words array<string>, pairs array<string>")
    asked = cut(asked.withColumn("h", F.xxhash64("text")))

    def met(column: str, table: DataFrame, key: str) -> DataFrame:
        each = asked.select("h", F.explode(column).alias(key))
        return salted_join(each, table, key)

    # what is looked up holds for all documents: texts that share a hash may share their rows
    both = met("words", tables[0], "k").unionByName(met("pairs", tables[1], "x"), allowMissingColumns=True)
    per = both.groupBy("h").agg(F.collect_set("k").alias("lower"), F.collect_set(F.when(F.col("x").isNotNull(), F.struct("x", "s"))).alias("p"))
    per = per.select("h", "lower", F.col("p.x").alias("pair"), F.col("p.s").alias("share"))

    def spans(b: pd.DataFrame) -> list[list[tuple[int, int, str]]]:
        lower = frozenset(w for row in b["lower"] if row is not None for w in row)
        fixed = {x: float(s) for xs, ss in zip(b["pair"], b["share"]) if xs is not None for x, s in zip(xs, ss)}
        forms = [[(x, y, KINDS[k], g) for x, y, k, g in np.reshape(f, (-1, 4)).astype(int).tolist()] for f in b["forms"]]
        own = replace(shared.value, words=replace(shared.value.words, lower=lower, fixed=fixed))
        return own.spans_of([t or "" for t in b["text"]], forms)

    return salted_join(asked.drop("words", "pairs"), per, "h", "left", spread_by=["doc_id"]), spans


def find(docs: DataFrame, d: Detector) -> DataFrame:
    """Distinct (doc_id, kind, span) of docs (doc_id, text). Null and empty texts have none; texts are read whole."""
    docs, spans = _prepared(docs.where("text IS NOT NULL"), d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, k, t[x:y]) for i, t, s in zip(b["doc_id"], b["text"], spans(b)) for x, y, k in s]
            yield pd.DataFrame(out, columns=["doc_id", "kind", "span"])

    return docs.mapInPandas(run, "doc_id bigint, kind string, span string").distinct()


def redact(docs: DataFrame, d: Detector, placeholders: dict[str, str]) -> DataFrame:
    """(doc_id, text, n_found): the text with each span replaced by its placeholder and nothing else changed; a null text stays null."""
    docs, spans = _prepared(docs, d)

    def one(t: str, spans: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for a, b, k in spans:
            out += [t[at:a], placeholders.get(k, f"[{k.upper()}]")]
            at = b
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = spans(b)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [None if t is None else one(t, s) for t, s in zip(b["text"], found)], "n_found": [len(s) for s in found]})

    return docs.mapInPandas(run, "doc_id bigint, text string, n_found int")


def brand_words(items: DataFrame) -> frozenset[str]:
    """Lower-cased words of all brands in the table of items. They travel to every task, so more than fit a broadcast are an error."""
    words = items.select(F.explode(F.regexp_extract_all(F.lower("brand"), F.lit(r"[\p{L}]{3,}"), F.lit(0))).alias("w")).distinct()
    most = BROADCAST_BYTES // 64
    rows = words.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} brand words")
    return frozenset(r["w"] for r in rows)
