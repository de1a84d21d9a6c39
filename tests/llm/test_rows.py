"""Operators 2 to 6 and 8: row by row, exact where the contract is exact."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from data import documents, frame

from wakegrid.llm import packing
from wakegrid.llm.fingerprints import version_fingerprints
from wakegrid.llm.labelled import fold
from wakegrid.llm.licenses import Scanner, build_rules, license_scan, uncovered
from wakegrid.llm.packing import best_fit, knapsack, pack_documents, plan
from wakegrid.llm.quality import Machine, score_quality, train_quality
from wakegrid.llm.queries import tokenizer_path
from wakegrid.llm.toxicity import decode, letter_model, score_toxicity, train_toxicity
from wakegrid.llm.wrapper import extract_pages, main_text, matching, merge, tree


def test_license_words_and_base_phrases(spark):
    lines = ["All Rights  Reserved.", "CC-BY 4.0 and cc by", "the GNU General Public License v3 (general public license)", "occ by; cc bye", "Released under the MIT License.", "éall rights reserved"]
    rows = [*documents(), *[(500 + k, t, None, None, None) for k, t in enumerate(lines)]]
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    want = []
    for i, t, *_ in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        want.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = license_scan(frame(spark, rows, extra=True)).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=key) == sorted(want, key=key)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert "mit" in next(r["labels"] for r in got if r["doc_id"] == 504)


def test_license_rules_by_rank():
    scanner = Scanner()
    assert len(build_rules()) >= 200
    labels = lambda t: {s[3] for s in scanner.spans(t)}
    # the full statement silences the looser rules inside it
    assert labels("gnu general public license version 2 or (at your option) any later version") == {"gpl-2-or-later"}
    assert "apache-2.0" in labels("licensed under the apache\nlicense, version 2.0")
    assert labels("cc-by-nc-sa 4.0") == {"cc-by-nc-sa-4.0"}
    assert not labels("plain words about by and sa")


def test_suppression_equals_comparing_all_pairs():
    r = random.Random(6)
    for _ in range(200):
        spans = [(a, a + r.randrange(1, 9)) for a in (r.randrange(25) for _ in range(r.randrange(50)))]
        kept: list[tuple[int, int]] = []
        want = []
        for a, b in spans:
            want.append(not any(x <= a and b <= y for x, y in kept))
            kept += [(a, b)] * want[-1]
        assert uncovered(spans) == want


def test_scan_of_a_long_text_equals_the_rules_tried_one_by_one():
    """Without the gates and with all pairs compared; a text of 2 MB stays quick."""
    scanner = Scanner()
    text = " ".join(["released under the mit license, all rights reserved", "gnu lesser general public license version 2.1 or later", "cc-by-sa 4.0", "x"][k % 4] for k in range(60))
    found = sorted(((p, m.start() - m.end(), m.start(), label, m.end()) for p, label, _, pattern in scanner.rules for m in pattern.finditer(text) if m.end() > m.start()))
    kept: list[tuple] = []
    for p, _, a, label, b in found:
        if not any(x <= a and b <= y for x, y, _, _ in kept):
            kept.append((a, b, p, label))
    assert scanner.spans(text) == sorted(kept) and len(kept) > 40
    assert len(scanner.spans("released under the mit license. " * 60_000)) == 60_000


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    encoder = Tokenizer.from_file(path)
    odd = ["it's <|endoftext|> THE", "Ünï—code… №5 ﬁ", "J̌ Å İ", "x" * 9000]
    rows = [*documents(), *[(700 + k, t, None, None, None) for k, t in enumerate(odd)]]
    got = pack_documents(frame(spark, rows, extra=True), path, size=256).toPandas()
    want = []
    for i, t, *_ in rows:
        if i is not None:
            ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            want += [(i, k, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for k, s in enumerate(range(0, len(ids), 256))]
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 1
    assert pack_documents(frame(spark, []), path).count() == 0


def test_word_ids_are_the_tokenizers(monkeypatch):
    words = packing.WordIds(tokenizer_path())
    monkeypatch.setattr(packing, "WORDS_KEPT", 40)
    r = random.Random(2)
    bits = ["a", "B", "é", "É", "'s", "'", "!", "…", "́", "J̌", "İ", "9", " ", "\n", "\x1c", "\xa0", "@", "<|endoftext|>", "文", "×", "º", "the,", "THE"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(2000)]
    for at in range(0, 2000, 100):
        for t, ids in zip(texts[at : at + 100], words.ids([t.encode() for t in texts[at : at + 100]]), strict=True):
            assert ids.tolist() == words.encoder.encode(t, add_special_tokens=False).ids, t


def fewest(lengths: list[int], size: int) -> int:
    """Least number of sequences, by trying all."""
    from functools import cache

    @cache
    def best(left: tuple[int, ...]) -> int:
        if not left:
            return 0
        head, rest = left[0], left[1:]
        found = len(left)

        def fill(at: int, room: int, taken: tuple[int, ...]):
            nonlocal found
            found = min(found, 1 + best(tuple(rest[i] for i in range(len(rest)) if i not in taken)))
            for i in range(at, len(rest)):
                if rest[i] <= room:
                    fill(i + 1, room - rest[i], (*taken, i))

        fill(0, size - head, ())
        return found

    return best(tuple(sorted(lengths, reverse=True)))


def test_plan_against_the_optimum():
    r = random.Random(8)
    over = 0
    for _ in range(25):
        lengths = [r.choice([3, 4, 5, 6, 7, 11, 13]) for _ in range(9)]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        many = sum(m for _, m in plan(histogram, 20))
        assert fewest(lengths, 20) <= many <= sum(m for _, m in best_fit(histogram, 20))
        over += many - fewest(lengths, 20)
    assert over <= 2


def test_program_saves_sequences():
    """Lengths that best-fit puts together badly: 15,000 (2050, 1000, 1000), 10,000 (2050, 1350) and 3,334 (1350 x 3) are optimal."""
    histogram = {1000: 30_000, 1350: 20_000, 2050: 25_000}
    many, plain = (sum(m for _, m in p) for p in (plan(histogram, 4096), best_fit(histogram, 4096)))
    lengths = np.array(sorted(histogram))
    _, bound = packing.configurations(lengths, np.array([histogram[n] for n in lengths]), 4096, 0.01, 100_000)
    assert plain == 30_000 and many <= 28_340 and 0.95 * 28_333 < bound <= 28_334


def placed_by(made: list) -> dict[int, int]:
    placed: dict[int, int] = {}
    for filling, many in made:
        assert sum(n * a for n, a in filling.items()) <= 4096
        for n, a in filling.items():
            placed[n] = placed.get(n, 0) + a * many
    return placed


def test_program_ends_by_its_tolerance():
    """Hundreds of lengths that go two and three to a sequence: best-fit stays 1 % above the bound, the program does not."""
    histogram = {n: 200 + 1000 - abs(n - 1500) for n in range(1000, 2001, 2)}
    lengths = np.array(sorted(histogram))
    _, bound = packing.configurations(lengths, np.array([histogram[n] for n in lengths]), 4096, 0.002)
    made = plan(histogram, 4096)
    many, plain = (sum(m for _, m in p) for p in (made, best_fit(histogram, 4096)))
    assert bound <= many <= 1.0021 * bound and many < 0.99 * plain
    assert placed_by(made) == histogram


def test_plan_meets_the_volume():
    """Thousands of lengths: no sequence more than the places that the pieces take."""
    drawn = np.random.default_rng(4).lognormal(6.5, 0.8, 200_000).astype(int)
    drawn = drawn[(drawn > 0) & (drawn < 4000)]
    histogram = {int(n): int(c) for n, c in zip(*np.unique(drawn, return_counts=True), strict=True)}
    made = plan(histogram, 4096)
    assert sum(m for _, m in made) == -(-int(drawn.sum()) // 4096) < sum(m for _, m in best_fit(histogram, 4096))
    assert placed_by(made) == histogram


def test_plan_places_all():
    r = random.Random(3)
    for _ in range(20):
        histogram = {r.randrange(1, 65): r.randrange(1, 200) for _ in range(r.randrange(1, 30))}
        for made in (plan(histogram, 64, work=2000), best_fit(histogram, 64)):
            placed: dict[int, int] = {}
            for filling, many in made:
                assert sum(n * a for n, a in filling.items()) <= 64
                for n, a in filling.items():
                    placed[n] = placed.get(n, 0) + a * many
            assert placed == histogram
    assert plan({}, 64) == []
    assert knapsack(np.array([3, 5]), np.array([1.0, 1.9]), 11).tolist() == [2, 1]


def test_fingerprints(spark):
    rows = documents()
    docs = sorted(((i, t or "") for i, t, *_ in rows if i is not None))
    parts = lambda t: {m.rstrip(" ") for m in re.findall(r"(?:[^\s]+[^\S\n]*){1,16}", t, re.A)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = {}
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        want.setdefault(i, set()).add((len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(parts(t), parts(e)), 9), round(like(parts(t), parts(after)), 9)))
    got = version_fingerprints(frame(spark, rows, extra=True)).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in docs]
    for r in got:
        assert (r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) in want[r["doc_id"]]
    texts = dict(docs)
    by_text: dict[str, set] = {}
    for r in got:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert version_fingerprints(frame(spark, [])).count() == 0


@pytest.mark.parametrize("cells, each", [((12, 64), 8), ((2, 3), 2)])
def test_fingerprints_peel_and_retry(spark, monkeypatch, cells, each):
    """Crowded tables: most have to be peeled; and tables so small that the larger and the exact way decide."""
    from wakegrid.llm import fingerprints

    monkeypatch.setattr(fingerprints, "CELLS", cells)
    monkeypatch.setattr(fingerprints, "EACH", each)
    names = []
    monkeypatch.setattr(fingerprints, "kept", lambda df, name, kept=fingerprints.kept: names.append(name) or kept(df, name))
    rows = documents(3)
    docs = sorted(((i, t or "") for i, t, *_ in rows if i is not None))
    parts = lambda t: {m.rstrip(" ") for m in re.findall(r"(?:[^\s]+[^\S\n]*){1,16}", t, re.A)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want: dict[int, set] = {}
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        want.setdefault(i, set()).add((round(like(parts(t), parts(t[: len(t) - q] + after[:q])), 9), round(like(parts(t), parts(after)), 9)))
    got = version_fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(docs)
    assert all((round(r["near_edited"], 9), round(r["near_next"], 9)) in want[r["doc_id"]] for r in got)
    assert cells == (12, 64) or names == ["differences"] * 3


def test_fingerprints_in_slots(spark, monkeypatch):
    from wakegrid.llm import fingerprints

    monkeypatch.setattr(fingerprints, "SLOT_ROWS", 4)
    rows = [(r.randrange(-(2**62), 2**62), f"text {k}\nof {k}", None, None, None) for r in [random.Random(8)] for k in range(60)]
    order = sorted(rows)
    after = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    got = {r["doc_id"]: r["next"] for r in fingerprints.with_next(frame(spark, rows).select("doc_id", "text")).collect()}
    assert got == after


def labelled(spark, toxic: list[str], plain: list[str]):
    texts = [*toxic, *plain]
    docs = frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)] + [(9000, None, None, None, None), (9001, "", None, None, None)])
    labels = spark.createDataFrame([(k, int(k < len(toxic))) for k in range(len(texts))] + [(None, 1), (3, None), (9000, 0), (123456, 1)], "doc_id long, label int")
    return docs, labels


def test_toxicity_sees_through_disguise(spark):
    r = random.Random(4)
    words = "river stone garden quiet letter morning water paper silver window market narrow little common house".split()
    talk = lambda n: [r.choice(words) for _ in range(n)]
    bad = ["idiot", "moron", "worthless"]
    toxic = [" ".join(talk(20) + [r.choice(bad)] + talk(20)) for _ in range(120)]
    plain = [" ".join(talk(40)) for _ in range(240)]
    docs, labels = labelled(spark, toxic, plain)
    model = train_toxicity(docs, labels)
    cases = {1: "quiet 1d10t river", 2: "you m0r0n", 3: "w o r t h l e s s", 4: "i.d.i.o.t", 5: "idiooot", 6: "quiet river water", 7: None, 8: "", 9: "IDIOT"}
    got = {x["doc_id"]: x["score"] for x in score_toxicity(frame(spark, [(k, t, None, None, None) for k, t in cases.items()], extra=True), model, ["region"]).collect()}
    assert all(got[k] >= 0.5 for k in (1, 2, 3, 4, 5, 9)), got
    assert all(0 <= got[k] < 0.5 for k in (6, 7, 8)), got
    cost = letter_model(docs)
    assert decode("m0r0n", cost) == "moron"
    # no labels at all: a constant score
    none = train_toxicity(docs, labels.where("doc_id < 0"))
    assert len({x["score"] for x in score_toxicity(docs, none).collect()}) == 1


def test_quality_held_out(spark):
    r = random.Random(6)
    words = [f"word{k}" for k in range(400)]
    good = lambda: " ".join(r.choice(words) for _ in range(60)) + ".\n"
    junk = lambda: " ".join(r.choice(words) + r.choice(["%%%", "***", "&&&"]) for _ in range(60))
    docs, labels = labelled(spark, [good() for _ in range(150)], [junk() for _ in range(150)])
    machine = train_quality(docs, labels.where(fold(4) != 2))
    got = {x["doc_id"]: x["score"] for x in score_quality(docs, machine).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values())
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k] >= 0.7) == (k < 150) for k in held]) > 0.95
    assert got[9000] == got[9001]


def test_machine_pairs_are_the_double_sum():
    """The sum-of-squares identity against the sum over pairs."""
    r = np.random.default_rng(1)
    m = Machine(3)
    m.word_v[:] = r.normal(size=m.word_v.shape)
    stats, words = np.zeros((1, 15)), np.array([5, 9, 9, 77])
    stats[0, :3] = (0.5, 0.2, 1.5)
    raw, _, x = m.forward(stats, words, np.array([0, 4]))
    v = np.concatenate([m.stat_v * stats.T, x[0] * m.word_v[words]])
    assert np.isclose(raw[0], sum(v[i] @ v[j] for i in range(len(v)) for j in range(i)))


PAGE = "<html><head><title>t</title></head><body><nav><ul><li>menu</ul></nav><div class='{c}'>{fixed}</div><article><h1>{title}</h1>{body}</article><footer>foot</footer></body></html>"


def test_extraction(spark):
    pages = [(k, f"https://Host.example/{k}", PAGE.format(c="x1", fixed="Same words everywhere", title=f"Title {k} &amp; more", body=f"<p>one {k}\n two<br>three<p>four <b>bold</b> {k}<div class='comments'><p>bad</div>")) for k in range(12)]
    pages += [(50, None, None), (51, "http://other.example", ""), (52, "x", "<p>open <i>text"), (53, "http://h2.example", "<div>plain &#x41;</div><script>if (a<b) {}</script><!-- no -->"), (None, "https://host.example", pages[0][2]), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = extract_pages(df).collect()
    assert len(got) == len(pages)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[3] == "Title 3 & more\none 3 two three\nfour bold 3"
    assert (texts[50], texts[51], texts[52], texts[53]) == ("", "", "open text", "plain A")
    assert extract_pages(df.limit(0)).count() == 0


def test_template_text_goes_without_an_article(spark):
    body = "<html><body><div class=a>Welcome here</div><div class=b>{}</div><div class=c>Bye</div></body></html>"
    df = spark.createDataFrame([(k, "http://h.example/", body.format(f"own text {k}")) for k in range(10)], "page_id long, url string, html string")
    assert {r["text"] for r in extract_pages(df).collect()} == {f"own text {k}" for k in range(10)}


def test_tree_matching():
    a, b = ["r", [["x", []], ["y", [["z", []]]]]], ["r", [["y", [["z", []], ["q", []]]], ["w", []]]]
    assert matching(a, b, {})[0] == 3
    whole = merge(a, b)
    assert json.dumps(whole) == json.dumps(["r", [["x", []], ["y", [["z", []], ["q", []]]], ["w", []]]])
    assert main_text(tree("<main><p>a</main>"), {}, set()) == "a"
