"""License scan by ordered signature rules.

A rule is (priority, label, gate word, pattern).  A text is first searched for
the gate words at once; only rules whose gate occurs are tried, in order.  When
spans found by two rules overlap, a span that lies inside one of an earlier or
equal rank is suppressed, so that a full notice silences the loose mention in it.

The base phrases are counted by words, apart from the rules, and their labels
always stay.  Null and empty texts have no words, no labels and score 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import id_and_text
from .text import lower_ascii, slices, word_bounds

#: Fixed values of the contract: phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Bytes that are no part of a word: \\x00-\\x2F, \\x3A-\\x60, \\x7B-\\x7F, after lower-casing.
BREAK = np.zeros(256, bool)
BREAK[0x00:0x30] = BREAK[0x3A:0x61] = BREAK[0x7B:0x80] = True

RULE = tuple[int, str, str, str]


def version(number: str) -> str:
    return number.replace(".", r"\.") + r"(?:\.0)?" if "." not in number else number.replace(".", r"\.")


def gnu_rules() -> Iterator[RULE]:
    kinds = (("gpl", r"(?:gnu )?general public licen[cs]e"), ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e"), ("agpl", r"(?:gnu )?affero general public licen[cs]e"), ("gfdl", r"(?:gnu )?free documentation licen[cs]e"))
    numbers = {"gpl": ("1", "2", "3"), "lgpl": ("2", "2.1", "3"), "agpl": ("1", "3"), "gfdl": ("1.1", "1.2", "1.3")}
    for label, long in kinds:
        gate = "documentation" if label == "gfdl" else "general public"
        for n in numbers[label]:
            v = version(n)
            yield 10, f"{label}-{n}-or-later", gate, rf"\b{long},? (?:as published by [a-z ]{{0,60}},? )?(?:either )?version {v},? (?:of the licen[cs]e,? )?or (?:\(at your option\) )?any later version\b"
            yield 12, f"{label}-{n}-only", gate, rf"\b{long},? version {v} only\b"
            yield 20, f"{label}-{n}", gate, rf"\b{long},? (?:version |v\.? ?){v}\b"
            yield 22, f"{label}-{n}", label, rf"\b{label}[- ]?v?\.? ?{v}(?![\d.]*\d)"
            yield 11, f"{label}-{n}-or-later", label, rf"\b{label}[- ]?v?\.? ?{v}(?:\+| or later|-or-later)"
            yield 12, f"{label}-{n}-only", label, rf"\b{label}[- ]?v?\.? ?{v}(?: only|-only)\b"
        yield 50, label, gate, rf"\b{long}\b"
        yield 60, label, label, rf"\b(?:under|licen[cs]ed?|terms of|the) (?:the )?(?:gnu )?{label}\b"


def creative_commons_rules() -> Iterator[RULE]:
    words = {"by": "attribution", "sa": "share ?-?alike", "nc": "non-?commercial", "nd": "no ?-?deriv(?:ative)?s?(?: works)?"}
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        parts = kind.split("-")
        short, long = "[- ]".join(parts), r"[- ,/]{1,3}".join(words[p] for p in parts)
        for n in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            v = n.replace(".", r"\.")
            yield 15, f"cc-{kind}-{n}", "creativecommons", rf"creativecommons\.org/licenses/{kind}/{v}"
            yield 18, f"cc-{kind}-{n}", "cc", rf"\bcc[- ]{short}[- ]v?{v}\b"
            yield 18, f"cc-{kind}-{n}", "creative commons", rf"\bcreative commons {long} (?:licen[cs]e )?(?:version )?{v}\b"
        yield 40 - len(parts), f"cc-{kind}", "cc", rf"\bcc[- ]{short}\b"
        yield 40 - len(parts), f"cc-{kind}", "creative commons", rf"\bcreative commons {long}\b"
    yield 30, "cc0", "cc0", r"\bcc0(?:[- ]1\.0)?\b"
    yield 30, "cc0", "creativecommons", r"creativecommons\.org/publicdomain/zero/1\.0"
    yield 70, "creative-commons", "creative commons", r"\bcreative commons\b"


def permissive_rules() -> Iterator[RULE]:
    yield 5, "mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy\b.{0,1200}?\bwithout warranty of any kind"
    yield 6, "mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"
    yield 5, "isc", "permission to use", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose"
    yield 5, "bsd-3-clause", "redistribution", r"redistribution and use in source and binary forms\b.{0,1500}?\bneither the name of"
    yield 6, "bsd-2-clause", "redistribution", r"redistribution and use in source and binary forms"
    yield 5, "apache-2.0", "apache", r"licen[cs]ed under the apache licen[cs]e,? version 2\.0(?:.{0,80}?you may not use this file)?"
    yield 5, "zlib", "as-is", r"this software is provided ['\"`]*as-is['\"`]*, without any express or implied warranty"
    yield 5, "unlicense", "unencumbered", r"free and unencumbered software released into the public domain"
    for label, names, numbers in (
        ("apache", r"apache(?: software)?", ("1.0", "1.1", "2.0")),
        ("mpl", r"(?:mozilla public|mpl)", ("1.0", "1.1", "2.0")),
        ("epl", r"(?:eclipse public|epl)", ("1.0", "2.0")),
        ("eupl", r"(?:european union public|eupl)", ("1.0", "1.1", "1.2")),
        ("cddl", r"(?:common development and distribution|cddl)", ("1.0", "1.1")),
        ("artistic", r"artistic", ("1.0", "2.0")),
        ("afl", r"(?:academic free|afl)", ("2.0", "2.1", "3.0")),
        ("osl", r"(?:open software|osl)", ("1.0", "2.0", "2.1", "3.0")),
        ("bsl", r"(?:boost software|bsl)", ("1.0",)),
        ("ofl", r"(?:sil open font|ofl)", ("1.0", "1.1")),
        ("odbl", r"(?:open database|odbl)", ("1.0",)),
        ("cecill", r"cecill(?:-[bc])?", ("1.0", "2.0", "2.1")),
        ("lppl", r"(?:latex project public|lppl)", ("1.0", "1.2", "1.3")),
        ("python", r"(?:python software foundation|psf)", ("2.0",)),
        ("ms-pl", r"(?:microsoft public|ms-?pl)", ("1.0",)),
        ("wtfpl", r"wtfpl", ("1.0", "2.0")),
    ):
        gate = re.sub(r"\W.*", "", names.lstrip("(?:"))
        for n in numbers:
            v = n.replace(".", r"\.").replace(r"\.0", r"(?:\.0)?")
            yield 20, f"{label}-{n}", gate, rf"\b{names}(?: licen[cs]e)?,? ?-?(?:version |v\.? ?)?{v}(?![\d.]*\d)"
            if label not in (gate, "python"):
                yield 21, f"{label}-{n}", label, rf"\b{label}[- ]v?{v}(?![\d.]*\d)"
        yield 55, label, gate, rf"\b{names} licen[cs]e\b"
    for label, names in (
        ("mit", r"(?:mit|expat|x11)"), ("isc", r"isc"), ("zlib", r"zlib(?:/libpng)?"), ("bsd", r"bsd"), ("beerware", r"beer-?ware"), ("unlicense", r"unlicense"),
        ("ncsa", r"(?:ncsa|university of illinois)"), ("postgresql", r"postgresql"), ("curl", r"curl"), ("openssl", r"openssl"), ("php", r"php"), ("ruby", r"ruby"), ("vim", r"vim"), ("json", r"json"),
    ):
        gate = "licen"
        yield 25, label, gate, rf"\b(?:released|distributed|available|licen[cs]ed|provided|published) (?:\w+ ){{0,3}}under (?:the )?(?:terms of (?:the )?)?{names}(?:[- ]style)? licen[cs]e\b"
        yield 56, label, gate, rf"\b{names}(?:[- ]style)? licen[cs]e\b"
        yield 57, label, "spdx", rf"spdx-licen[cs]e-identifier: ?{names}\b"
    for n, words in (("2", "two|simplified|freebsd"), ("3", "three|new|revised|modified"), ("4", "four|original")):
        yield 20, f"bsd-{n}-clause", "bsd", rf"\bbsd[- ]{n}[- ]clause\b"
        yield 20, f"bsd-{n}-clause", "bsd", rf"\b(?:{n}|{words})[- ](?:clause )?bsd\b"


def closed_rules() -> Iterator[RULE]:
    for label, gate, pattern in (
        ("reserved", "rights reserved", r"\b(?:all|some) rights (?:are )?reserved\b"),
        ("no-rights-reserved", "rights reserved", r"\bno rights reserved\b"),
        ("public-domain", "public domain", r"\b(?:in|into|to) the public domain\b"),
        ("proprietary", "proprietary", r"\bproprietary (?:and|&) confidential\b"),
        ("proprietary", "proprietary", r"\bproprietary (?:software|information|licen[cs]e)\b"),
        ("no-reproduction", "reproduc", r"\b(?:may|must|shall) not be (?:reproduced|copied|redistributed)\b"),
        ("no-reproduction", "reproduc", r"\bno part of this \w+ may be reproduced\b"),
        ("no-copying", "unauthori", r"\bunauthori[sz]ed (?:copying|use|reproduction|distribution)\b"),
        ("written-permission", "permission", r"\bwithout (?:the )?(?:prior )?(?:express )?written (?:permission|consent)\b"),
        ("personal-use", "personal", r"\bfor personal(?:,| and)? (?:non-?commercial )?use only\b"),
        ("non-commercial", "commercial", r"\b(?:for )?non-?commercial (?:use|purposes) only\b"),
        ("evaluation", "evaluation", r"\bfor evaluation (?:use|purposes) only\b"),
        ("shareware", "shareware", r"\bshareware\b"),
        ("freeware", "freeware", r"\bfreeware\b"),
        ("trade-secret", "trade secret", r"\btrade secrets?\b"),
        ("eula", "end user", r"\bend[- ]user licen[cs]e agreement\b"),
        ("terms-of-service", "terms of", r"\bsubject to (?:our |the )?terms of (?:service|use)\b"),
    ):
        yield 35, label, gate, pattern
    yield 45, "copyright-notice", "copyright", r"\bcopyright (?:\(c\)|©)? ?(?:\d{4}(?:[-,–] ?\d{2,4})*)?"
    yield 46, "copyright-notice", "(c)", r"\(c\) ?\d{4}"
    yield 46, "copyright-notice", "©", r"© ?\d{4}"
    yield 80, "license-mention", "licen", r"\blicen[cs]ed? (?:under|agreement|terms|notice)\b"


def build_rules() -> list[RULE]:
    """All rules in the order in which they are tried."""
    found = [*gnu_rules(), *creative_commons_rules(), *permissive_rules(), *closed_rules()]
    return sorted(dict.fromkeys(found), key=lambda r: r[0])


def confidence(priority: int) -> float:
    """Chance that a text with such a detection states its license, by rank of the rule."""
    return round(max(0.3, 1 - priority / 100), 3)


def uncovered(spans: list[tuple[int, int]]) -> list[bool]:
    """Of spans in order of rank: whether no earlier one contains the span.

    A sweep by start with a tree of running largest ends over the ranks: a span is
    covered when, of the spans that begin no later, one of smaller rank ends no
    earlier.  Whether that one is covered itself makes no difference, as what covers
    it covers this one too.
    """
    n = len(spans)
    tree = [-1] * (n + 1)
    free = [True] * n
    order = sorted(range(n), key=lambda k: spans[k][0])
    at = 0
    while at < n:
        to = at
        while to < n and spans[order[to]][0] == spans[order[at]][0]:
            k, end = order[to] + 1, spans[order[to]][1]
            while k <= n and tree[k] < end:
                tree[k] = end
                k += k & -k
            to += 1
        for i in order[at:to]:
            k, end = i, spans[i][1]  # ranks before this one
            while k and tree[k] < end:
                k -= k & -k
            free[i] = k == 0
        at = to
    return free


class Scanner:
    def __init__(self, rules: list[RULE] | None = None):
        import ahocorasick

        self.rules = [(p, label, gate, re.compile(pattern, re.S)) for p, label, gate, pattern in (build_rules() if rules is None else rules)]
        self.gates = ahocorasick.Automaton()
        by_gate: dict[str, list[int]] = {}
        for k, r in enumerate(self.rules):
            by_gate.setdefault(r[2], []).append(k)
        for gate, numbers in by_gate.items():
            self.gates.add_word(gate, numbers)
        self.gates.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, str]]:
        """(start, end, priority, label) of detections, those inside a stronger one left out."""
        text = text.translate(FLAT)
        tried = sorted({k for _, numbers in self.gates.iter(text) for k in numbers})
        found = [(m.start(), m.end(), self.rules[k][0], self.rules[k][1]) for k in tried for m in self.rules[k][3].finditer(text) if m.end() > m.start()]
        # by rank, then the longer, then the earlier: a span is kept unless an earlier one contains it
        found.sort(key=lambda s: (s[2], s[0] - s[1], s[0], s[3]))
        kept = [span for span, free in zip(found, uncovered([s[:2] for s in found]), strict=True) if free]
        return sorted(kept)


#: Line ends and tabs count as blanks for the rules; places stay the same.
FLAT = dict.fromkeys(range(9, 14), 32)

#: ASCII letters in lower case, everything else as it is.
LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE_PATTERNS = [(re.compile(r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(p.split()) + r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"), label) for p, label in BASE_PHRASES.items()]
#: A text without any of these holds no base phrase.
BASE_KEYS = ("general", "reserved", "cc")


def base_places(text: str) -> list[tuple[int, str]]:
    """(number of the phrase's first word, label) of every place of a base phrase in a lower-cased text."""
    at = [(m.start(), label) for pattern, label in BASE_PATTERNS for m in pattern.finditer(text)]
    if not at:
        return []
    starts = [m.start() for m in WORD.finditer(text)]
    return sorted((int(np.searchsorted(starts, a)), label) for a, label in at)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan(rules: list[RULE] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            ids, counts, rows = batch.column(0).to_pylist(), [], []
            for _, n, data, offsets in slices(batch):
                data = lower_ascii(data)
                counts += np.diff(word_bounds(data, offsets, BREAK)[2]).tolist()
                raw = data.tobytes()
                for i in range(n):
                    text = raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
                    places = base_places(text) if any(k in text for k in BASE_KEYS) else []
                    spans = scanner.spans(text)
                    base = {label for _, label in places}
                    missed = 1.0
                    for p in {p for _, _, p, _ in spans}:
                        missed *= 1 - confidence(p)
                    if base:
                        missed *= 0.1
                    rows.append((len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {s[3] for s in spans})), 1 - missed, ";".join(f"{a}-{b}:{label}" for a, b, _, label in spans)))
            n_base, first, last, base, labels, score, spans = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return run


def license_scan(docs: DataFrame, rules: list[RULE] | None = None) -> DataFrame:
    """A row per row of ``docs``: word count, base phrases, labels, score and the detections' spans (code points)."""
    return id_and_text(docs).mapInArrow(scan(rules), SCHEMA)
