"""Tokens, mixtures and subjects of documents."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessella.llm import mixing as M
from tessella.llm import subjects as S
from tessella.llm import tokens as T

DOCS = "doc_id bigint, text string, source string, lang string"
TEXTS = [None, "", " ", "plain", "é 中文 \U0001f600", "<|endoftext|> is text", "a\r\n\tb  c\x00", "x" * 300_000, "0 " * 100_000, "\xa0​"]


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, sources[i] if sources else None, "en") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.tokenizer_file())
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_and_round_trip(spark, plain):
    df = docs(spark, TEXTS)
    ids = {r.doc_id: r.ids for r in T.encode(df).collect()}
    assert ids == {i: plain(t) if t else [] for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in T.decode(T.encode(df)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.tokens for r in T.count_tokens(df, ["doc_id", "source"]).collect()} == {i: len(v) for i, v in ids.items()}
    assert T.encode(df.limit(0)).count() == 0


def test_other_tokenizer_library_agrees():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    assert {i: b for b, i in ranks.items()}.items() <= T.token_bytes(T.tokenizer_file()).items()
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [list(e.ids) for e in T._encoded(["héllo wörld 中文"], T.tokenizer_file())] == [other.encode_ordinary("héllo wörld 中文")]


def test_offsets_tell_split_characters(spark):
    known = T.token_bytes(T.tokenizer_file())
    for r in T.offsets(docs(spark, TEXTS[:7])).collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        assert b"".join(known[i] for i in r.ids) == raw
        for i, at, split in zip(r.ids, r.first_byte, r.split):
            assert raw[at : at + len(known[i])] == known[i]
            end = at + len(known[i])
            assert split == (end < len(raw) and raw[end] & 0xC0 == 0x80)


TARGETS = "source string, target_weight double, max_repeats int"


def _mixture(spark):
    rng = random.Random(4)
    sources = ["big"] * 400 + ["Small "] * 40 + ["tiny"] * 5 + [None, " ", "other"]
    texts = [" ".join("word" for _ in range(rng.randint(1, 60))) for _ in sources]
    texts[3] = None
    return docs(spark, texts, sources), spark.createDataFrame([("big", 0.5, 2), ("SMALL", 0.3, 9), ("tiny", 0.15, 2), ("ghost", 0.05, 3)], TARGETS)


def test_mixture_reaches_its_shares(spark):
    df, targets = _mixture(spark)
    sized = M.sizes(df)
    plan = {r.source: r for r in M.plan(sized, targets).collect()}
    assert sized.count() == 446 and plan["ghost"].short and plan["tiny"].short and not plan["big"].short
    assert rows(M.unreachable(df, targets)) == [("ghost",), ("tiny",)]
    mixed = M.mix(sized, targets).collect()
    assert rows(M.mix(sized, targets)) == sorted((tuple(r) for r in mixed), key=repr)  # the same draw again
    caps = {"big": 2, "small": 9, "tiny": 2}
    assert all(0 < r.copies <= caps[r.source] for r in mixed)
    total = plan["big"].total
    used = {s: sum(r.tokens * r.copies for r in mixed if r.source == s) for s in caps}
    assert used["big"] / total == pytest.approx(0.5, abs=0.03) and used["small"] / total == pytest.approx(0.3, abs=0.03)
    assert {r.doc_id for r in mixed if r.source == "tiny"} == {440, 441, 442, 443, 444} and used["tiny"] == 2 * plan["tiny"].have
    shares = {r.source: r for r in M.shares(M.mix(sized, targets), sized, targets).collect()}
    assert shares["SMALL"].used == used["small"] and shares["ghost"].used == 0 and shares["ghost"].short


def test_draw_follows_inclusion_odds(spark):
    """Fixed size; longer documents are drawn more often than short ones."""
    texts = ["w " * (5 if i % 2 else 50) for i in range(600)]
    df, targets = docs(spark, texts, ["s"] * 600), spark.createDataFrame([("s", 0.4, 1)], TARGETS)
    mixed = M.mix(M.sizes(df), targets).collect()
    long = sum(r.doc_id % 2 == 0 for r in mixed)
    assert long > 3 * (len(mixed) - long) > 0


def test_mixture_of_nothing(spark):
    df, targets = _mixture(spark)
    assert M.mix(M.sizes(df.limit(0)), targets).count() == 0
    assert M.unreachable(df, targets.limit(0)).count() == 0
    assert rows(M.unreachable(docs(spark, [None, ""], ["big", "tiny"]), targets)) == []
    odd = spark.createDataFrame([("big", None, None)], TARGETS)
    assert M.mix(M.sizes(df), odd).count() == 0


def _corpus(spark, n=240):
    rng = random.Random(5)
    words = {s: [f"{s}{c}" for c in "abcdefgh"] for s in ("law", "sport", "health")}
    line = lambda s: rng.choice(["Note that {} follows {}.", "The part on {} shows {}!", "Is {} more than {}?"]).format(*rng.sample(words[s], 2))
    texts, truth = [], []
    for i in range(n):
        own = rng.sample(list(words), 2 if i % 5 == 0 else 1)
        lines = [line(own[k % len(own)]) for k in range(10)]
        if i % 4 == 0:
            other = next(s for s in words if s not in own)
            lines.insert(5, line(other))  # a passing mention
        if i % 12 == 1:
            lines, own = ["Hand in the form before noon."] * 6, []
        texts.append("\n".join(lines) if i % 2 else " ".join(lines))
        truth.append(set(own))
    labels = [(i, sorted(t)[0]) for i, t in enumerate(truth) if t and i % 3]
    labels[5] = (labels[5][0], "sport")
    return texts, truth, labels


def test_subjects(spark):
    texts, truth, labels = _corpus(spark)
    df = docs(spark, [*texts, None, "", " \n"])
    known = spark.createDataFrame([("law", "x"), ("sport", "y"), ("health", "z")], "subject string, about string")
    given = spark.createDataFrame(labels + [(0, "no such subject"), (9999, "law"), (None, None)], "doc_id bigint, subject string")
    found: dict[int, set] = {}
    for r in S.subjects(df, given, known).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(found.get(i, set()) == t for i, t in enumerate(truth))
    assert right / len(truth) > 0.95 and not any(i in found for i in (240, 241, 242))
    assert S.subjects(df, given.limit(0), known).count() == 0
    assert S.subjects(df.limit(0), given, known).count() == 0


def test_every_document_reaches_the_rules(spark, monkeypatch):
    """Words of a few documents among many are learned, whichever documents these are."""
    for name in ("FIT", "POOL"):
        monkeypatch.setattr(S, name, 40, raising=False)  # bounds of an earlier version
    plain = {"law": "Court and judge agree. The judge saw the court. A court it is.", "sport": "Team and goal agree. The goal beat the team. A team it is."}
    texts = [plain["sport" if i % 2 else "law"] for i in range(240)]
    for i in (50, 92, 134, 176, 218):
        texts[i] += " Tort follows estoppel."
    df = docs(spark, [*texts, "Is tort more than estoppel? Tort and estoppel."])
    labels = spark.createDataFrame([(i, "sport" if i % 2 else "law") for i in range(20)], "doc_id bigint, subject string")
    known = spark.createDataFrame([("law", ""), ("sport", "")], "subject string, about string")
    assert (240, "law") in rows(S.subjects(df, labels, known))


def test_labels_stay_in_later_fits(spark):
    """A subject of short documents, none of them sure, keeps its rules."""
    plain = {"law": "Court and judge agree. The judge saw the court. A court it is.", "sport": "Team and goal agree. The goal beat the team. A team it is.", "health": "Pulse and fever."}
    own = [("law", "sport", "health")[i % 3] for i in range(60)]
    labels = spark.createDataFrame([(i, own[i]) for i in range(30)], "doc_id bigint, subject string")
    known = spark.createDataFrame([(s, "") for s in plain], "subject string, about string")
    assert rows(S.subjects(docs(spark, [plain[s] for s in own]), labels, known)) == sorted(enumerate(own), key=repr)
    old, new = [(("a",), "law", 1.0), (("b",), "health", 1.0)], [(("c",), "law", 2.0)]
    assert S.succeed(old, new) == [new[0], old[1]] and S.succeed(old, []) == old


def test_rules_are_pruned(spark):
    data = [("a", ["w", "x"])] * 20 + [("b", ["x", "y"])] * 20 + [("b", ["z"])] * 5 + [("a", ["z"])] * 5
    rules, prior = S.mine(spark.createDataFrame(data, "subject string, words array<string>"))
    assert prior["a"] == 0.5 and {(w, s) for w, s, _ in rules} == {(("w",), "a"), (("y",), "b")}


def test_rules_of_many_words(spark):
    """Only four words together tell."""
    every = ["w", "x", "y", "z"]
    data = [("a", every)] * 40 + [("b", [w for w in every if w != out]) for out in every] * 4 + [("b", ["q"])] * 24
    rules, _ = S.mine(spark.createDataFrame(data, "subject string, words array<string>"))
    assert (tuple(every), "a") in {(w, s) for w, s, _ in rules}


def test_rules_seen_in_three_statements(spark):
    """Whatever the number of statements."""
    n = next(n for n in range(100, 9999, 2) if 3 / n * n > 3)
    data = [("a", ["x", "rare"])] * 3 + [("a", ["x"])] * (n // 2 - 3) + [("b", ["y"])] * (n // 2)
    rules, _ = S.mine(spark.createDataFrame(data, "subject string, words array<string>"))
    assert (("rare",), "a") in {(w, s) for w, s, _ in rules}


def test_repeated_long_lines_end(spark):
    """A line of forty leaning words, repeated and with single words left out, is mined without listing its subsets."""
    import time

    words = ["w" + a + b for a in "abcdefgh" for b in "abcde"]
    data = [("a", words)] * 30 + [("a", [w for w in words if w != out]) for out in words] + [("a", [w]) for w in words] * 2 + [("b", [w]) for w in words] + [("b", ["other"])] * 60
    began = time.time()
    rules, _ = S.mine(spark.createDataFrame(data, "subject string, words array<string>"))
    assert time.time() - began < 90 and (("other",), "b") in {(w, s) for w, s, _ in rules}


def test_mined_rules_against_all_itemsets(spark):
    """The rules are those of listing every itemset and pruning against every subset."""
    import itertools
    import math

    rng = random.Random(8)
    data = []
    for _ in range(160):
        s = rng.choice("ab")
        data.append((s, sorted({w for w in "uvwxyz" if rng.random() < (0.55 if (w in "uvw") == (s == "a") else 0.2)})))
    data = [(s, w) for s, w in data if w]
    prior = {s: sum(t == s for t, _ in data) / len(data) for s in "ab"}
    conf = {}
    leaning = [w for w in "uvwxyz" if any(sum(s == t and w in ws for t, ws in data) >= S.SUPPORT and (sum(s == t and w in ws for t, ws in data) / sum(w in ws for _, ws in data) - prior[s]) / (1 - prior[s]) >= S.WORD_GAIN for s in "ab")]
    for k in range(1, S.LONGEST + 1):
        for x in itertools.combinations(leaning, k):
            cover = [s for s, ws in data if set(x) <= set(ws)]
            for s in "ab":
                if cover.count(s) >= S.SUPPORT:
                    conf[x, s] = (cover.count(s) + S.SHRINK * prior[s]) / (len(cover) + S.SHRINK)
    want = {}
    for (x, s), c in conf.items():
        subs = [y for k in range(1, len(x)) for y in itertools.combinations(x, k)]
        if c - prior[s] >= S.GAIN * (1 - prior[s]) and not any(conf.get((y, s), 0) >= c - 1e-12 for y in subs):
            want[x, s] = math.log(c / prior[s])
    rules, _ = S.mine(spark.createDataFrame(data, "subject string, words array<string>"))
    assert {(w, s): pytest.approx(e) for w, s, e in rules} == want and len(want) > 3


def test_shares_of_a_statement():
    scorer = S.Scorer([(("a",), "x", 2.0), (("a", "b"), "y", 2.0), (("c",), "y", 9.0)])
    assert scorer.statement({"a"}) == {"x": 1.0} and scorer.statement({"a", "b"}) == {"x": 0.5, "y": 0.5}
    size, votes = scorer.document([["a"], ["c", "a"], ["q"]])
    assert size == 3 and votes["x"] == pytest.approx(1.0009, abs=1e-3)


def test_very_long_statements_are_read_whole():
    parts = S.statements(" ".join("w" + "abcdefghij"[i // 100] + "abcdefghij"[i // 10 % 10] + "abcdefghij"[i % 10] for i in range(1000)))
    assert len(set().union(*parts)) == 1000 and max(map(len, parts)) <= S.WINDOW


def test_statements():
    assert S.statements("One is here. Two\nit 中文字。中") == [{"one", "is", "here"}, {"two"}, {"it", "中文", "文字"}]
    assert S.statements(None) == [] and F is not None
