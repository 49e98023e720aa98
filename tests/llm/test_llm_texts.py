"""Operators on single texts, held against plain versions and on awkward inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.llm import chat, pii, secrets, sentencepieces, suffixes, token_counts, toxicity, winnow
from trapline.llm.queries import BYTES, PIECES, PROBE, tokenizer_path

SCHEMA = "doc_id long, text string, id string, tid string, row string, spans string"
AWKWARD = [
    (1, None, "a", "a", "a", "a"), (2, "", "a", "a", "a", "a"), (None, "no id here", "a", "a", "a", "a"),
    (3, "one two three four five six seven eight nine ten eleven", "a", "a", "a", "a"),
    (3, "one two three four five six seven eight nine ten eleven", "a", "a", "a", "a"),
    (4, "Ünïcode ▁ straße\n\n  spaces   and\ttabs 🙂🙂 \x00 end ", "a", "a", "a", "a"),
    (5, "word " * 20_000, "a", "a", "a", "a"), (6, "x" * 30_000, "a", "a", "a", "a"),
    (7, "mail a.b@c.de_x@y.zz or 1.2.3.400 10.0.0.255 card 4111 1111 1111 1111 call +49 (30) 1234-5678.", "a", "a", "a", "a"),
    (8, "token=token=abcdef PASSWORD: 'hunter2x' api_key=short token:token:abcdefgh AKIA" + "A1" * 9 + " " + "ab12" * 8, "a", "a", "a", "a"),
    (9, "password = secret: longenough1", "a", "a", "a", "a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(row):
    return row[1] or ""


def by_input(rows):
    """Results in the order of their ids, for comparison with the same of the input."""
    return sorted(rows, key=repr)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_pii(text):
    found = []
    for kind, pattern in [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fails = {"email": False, "ip": kind == "ip" and any(int(p) > 255 for p in m.group().split(".")),
                     "card": not (16 <= len(digits) <= 19 and luhn(digits)), "phone": not 8 <= len(digits) <= 15}[kind]
            if not fails:
                found.append((kind, m.start(), m.end()))
    return found


def test_pii_base(spark, awkward):
    got = by_input((r.id, [(s.kind, s.begin, s.end) for s in r.base]) for r in pii.find(awkward).collect())
    assert got == by_input((r[0], plain_pii(text_of(r))) for r in AWKWARD)


def test_pii_marks_of_overlapping_kinds(spark):
    """Kinds marked one after the other mark exactly the characters of all base matches."""
    rng = np.random.default_rng(4)
    parts = ["a.b@", "1.2.3.4", "10.0.0.999", "x@y.zz", "4111 1111 1111 1111", "+49 30 ", "+4111-1111-1111-1111", "1234567", " ", ".", "-", "@", "+", "é", "\n", "378282246310005", "7"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(400)] + ["+49 10.0.0.255 (4111 1111 1111 1111)", "u@1.2.3.4 " * 3_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    cut = F.aggregate(F.array(*map(F.lit, pii.KINDS)), F.col("text"), pii._any_marked)
    for i, text in rows.select("i", cut.alias("cut")).collect():
        want = [False] * len(texts[i])
        for _kind, begin, end in plain_pii(texts[i]):
            want[begin:end] = [True] * (end - begin)
        assert [pii._MARKED[0] <= c <= pii._MARKED[-1] for c in text] == want, texts[i][:80]
        assert text.translate(str.maketrans(pii._MARKED, pii._PLAIN)) == texts[i]


def test_pii_contexts(spark):
    """A label that nearly always stands before known kinds reveals one of no known form."""
    rows = [(i, f"and then kontakt: user{i}@mail{i}.example.org said") for i in range(30)] + [
        (100, "so kontakt: AB-1234567-X said"), (101, "the then CD-7654321-Y stands without a label")]
    got = {r.id: [s.kind for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == ["context"] and got[101] == [] and got[3] == ["email"]


def test_pii_contexts_of_any_form(spark):
    """Short and dotless identifiers, and parts of runs before and after base matches, are found by their label."""
    rows = [(i, f"and then kontakt: user{i}@mail{i}.example.org said") for i in range(60)]
    cases = {
        100: ("so kontakt: @handle said", ["@handle"]), 101: ("so kontakt: user@host said", ["user@host"]),
        102: ("so kontakt: AB-12345 said", ["AB-12345"]), 103: ("so kontakt: CD-1234567 a@b.example said", ["CD-1234567"]),
        104: ("so kontakt: 🙂 x1", []), 105: ("so kontakt: a@b.example EF-7654321, said", ["EF-7654321"]),
        106: ("so kontakt:\n4111 1111 1111 1111 GH-77 +49 30 1234567 IJ-88 said", ["GH-77", "IJ-88"]),
        107: ("the then KL-1234567 stands", []), 108: ("kontakt: \U0010ff41\U0010ff42 said", []),
    }
    texts = rows + [(i, t) for i, (t, _) in cases.items()]
    found = {r.id: r.spans for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    got = {i: [t[s.begin:s.end] for s in found[i] if s.kind == "context"] for i, (t, _) in cases.items()}
    assert got == {i: want for i, (_, want) in cases.items()}


def test_pii_contexts_spread_until_nothing_changes(spark):
    """Each label is known only by identifiers that the label before it made sure."""
    labels = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    texts = [f"the alpha u{i}@mail.example said" for i in range(200)]
    for k in range(len(labels) - 1):
        texts += [f"the {labels[k]} Q{k}-{i} said" for i in range(6)] + [f"the {labels[k + 1]} Q{k}-{i} said" for i in range(6) for _ in range(10)]
    texts.append("the theta LAST-1 said")
    rows = list(enumerate(texts))
    got = {r.id: [s.kind for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[len(rows) - 1] == ["context"]


def plain_secrets(text):
    found = []
    for i, (kind, pattern) in enumerate([
            ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
            ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(2) if kind == "assign" else m.group()) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), i, m.end(), kind))
    return sorted(found)


def test_secrets(awkward):
    got = by_input((r.id, [tuple(f) for f in r.findings or []]) for r in secrets.findings_by_path(awkward).collect())
    assert got == by_input((r[0], plain_secrets(text_of(r))) for r in AWKWARD)


def test_secrets_redacted(awkward):
    clean = secrets.redact(awkward)
    assert clean.columns == awkward.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert "hunter2x" not in texts[8] and texts[8].count("[SECRET]") == len(plain_secrets(AWKWARD[9][1])) and texts[1] is None
    assert texts[3] == AWKWARD[3][1]


def test_secret_ledger_scans_only_what_is_new(spark, tmp_path):
    one = spark.createDataFrame([(1, "token = abcdefg"), (2, "token = abcdefg")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "token = abcdefg"), (4, "secret: hijklmnop")], "doc_id long, text string")
    path = str(tmp_path / "ledger")
    secrets.findings_by_path(one, ledger_path=path).collect()
    triples, _ = secrets.scan(two, secrets.open_ledger(spark, path))
    assert triples.count() == len(secrets.RULES)
    assert [len(r.findings) for r in secrets.findings_by_path(two, ledger_path=path).orderBy("id").collect()] == [1, 1]
    newer = [secrets.Rule(r.name, r.pattern, r.group, r.least, version=2) for r in secrets.RULES[:1]]
    triples, _ = secrets.scan(two, secrets.open_ledger(spark, path), rules=newer)
    assert triples.count() == 2


def test_pieces_of_whole_texts_are_decoded():
    """The decoded text comes from the text's own ids, and the library decodes them as a whole."""
    vocab = sentencepieces.Vocabulary(tokenizer_path(PIECES))
    texts = ["one two\nthree", "", "  Ünïcode ▁ 🙂"]
    plain = [t.replace("▁", " ") for t in texts]
    assert [(d, ok) for _, d, ok in vocab.encode(texts)] == [(t, True) for t in plain]

    class Faulty:
        """A library that decodes texts of several words wrongly."""

        def __init__(self, library):
            self.library = library

        def encode(self, *args, **options):
            return self.library.encode(*args, **options)

        def decode(self, lists, **options):
            return [t.replace(" two\n", " 2\n") for t in self.library.decode(lists, **options)]

    vocab.library = Faulty(vocab.library)
    assert [ok for _, _, ok in vocab.encode(texts)] == [False, True, True]
    vocab.known["▁two"] = (vocab.encode_stretch("▁three"), "0", " three")
    assert vocab.encode(["one two"])[0][1] == "one three"


def test_pieces_match_the_library(awkward):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    got = by_input((r.id, list(r.ids), r.decoded, r.agrees) for r in sentencepieces.encode(awkward, tokenizer_path(PIECES)).collect())
    want = [(r[0], library.encode(text_of(r), add_eos=True)) for r in AWKWARD]
    assert got == by_input((i, ids, library.decode(ids), True) for i, ids in want)


def test_both_agendas_agree():
    vocab = sentencepieces.vocabulary(tokenizer_path(PIECES))
    rng = np.random.default_rng(5)
    for _ in range(300):
        word = "".join(rng.choice(list("▁theinrsabcé"), size=rng.integers(1, 90)))
        assert vocab._merge_short(word) == vocab._merge_long(word)


def test_token_counts(awkward):
    import public_tokenizers
    import tiktoken

    path = tokenizer_path(BYTES)
    encoding = token_counts.encoder(path, public_tokenizers.PATTERN).encoding
    assert isinstance(encoding, tiktoken.Encoding)
    for rule in ("first", "last", "most", "share"):
        got = token_counts.section_tokens(awkward, path, public_tokenizers.PATTERN, rule=rule).collect()
        assert by_input((r.id, r.n_tokens) for r in got) == by_input((r[0], len(encoding.encode_ordinary(text_of(r)))) for r in AWKWARD)
        for r in got:
            assert sum(r.section_tokens) == pytest.approx(r.n_tokens) and len(r.section_tokens) == r.n_sections


def test_tokens_over_borders():
    begin, end, ends = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([3, 3 + 3])
    assert token_counts.allocate(begin, end, ends, "first").tolist() == [2, 1]
    assert token_counts.allocate(begin, end, ends, "last").tolist() == [1, 2]
    assert token_counts.allocate(begin, end, ends, "most").tolist() == [1, 2]
    assert token_counts.allocate(begin, end, ends, "share").tolist() == pytest.approx([1 + 1 / 3, 1 + 2 / 3])


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


def plain_contamination(text, items):
    words, hit, named = plain_words(text), set(), set()
    for name, item in items:
        other = plain_words(item or "")
        n = min(10, len(other))
        windows = {tuple(other[i:i + n]) for i in range(len(other) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in windows:
                hit.update(range(i, i + n))
                named.add("null" if name is None else str(name))
    return len(words), len(hit), sorted(named)


def test_winnowing(spark, awkward):
    items = [(1, "zero one TWO three, four five six seven eight nine ten no"), (2, "straße spaces"), (3, None), (4, ""), (None, "mail a"),
             (5, "word " * 15), (5, "one two"), (12, "ten eleven")]
    got = winnow.decontaminate(awkward, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert by_input((r.id, (r.n_words, r.n_hit, list(r["items"]))) for r in got) == by_input(
        (r[0], plain_contamination(text_of(r), items)) for r in AWKWARD)


def test_winnowing_random(spark):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(rng.choice(list("abc"), size=int(rng.integers(0, 60))))) for i in range(150)]
    items = [(i, " ".join(rng.choice(list("abc"), size=int(rng.integers(1, 25))))) for i in range(20)]
    got = winnow.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.id: (r.n_words, r.n_hit, list(r["items"])) for r in got.collect()} == {i: plain_contamination(t, items) for i, t in texts}


def plain_repeats(rows, length=100):
    """Removed bytes by brute force, rows in order of id, then digest."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], hashlib.md5((r[1] or "").encode()).digest())):
        data = (text or "").encode()
        if (i, text or "") in out:
            continue
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            if data[at:at + length] in seen:
                gone[at:at + length] = b"\1" * length
            else:
                seen[data[at:at + length]] = at
        runs = sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1]))
        out[i, text or ""] = (len(data), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest())
    return out


def check_repeats(frame, rows, **options):
    want = plain_repeats(rows)
    got = [(r.id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffixes.remove_repeats(frame, **options).collect()]
    assert by_input(got) == by_input((i, want[i, t or ""]) for i, t in rows)


def repeat_rows():
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(rng.choice(list("abcdefgé \n"), size=n))
    shared = [letters(n) for n in (90, 100, 101, 130, 260)]
    rows = [(i, letters(int(rng.integers(0, 200))) + shared[rng.integers(5)] + letters(int(rng.integers(0, 120))) + shared[rng.integers(5)])
            for i in range(60)]
    base = letters(700)
    rows += [(100 + i, base[:int(rng.integers(100, 600))] + "#" + base[int(rng.integers(100, 600)):]) for i in range(25)]
    return rows + [(200, base), (201, base), (201, base), (None, letters(150) + base), (202, None), (203, ""), (204, "ab" * 400), (205, "z" * 99)]


@pytest.mark.parametrize("hot", [100_000, 3])
def test_repeated_bytes(spark, hot):
    rows = repeat_rows()
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, hot=hot)


def test_loser_tree_merges_and_keeps_prefixes():
    rng = np.random.default_rng(2)
    runs = [sorted(bytes(rng.choice(list(b"ab"), size=rng.integers(1, 9))) for _ in range(rng.integers(0, 30))) for _ in range(5)]
    packed = [suffixes.unpack(suffixes.pack(r, *[list(range(len(r)))] * 3)) for r in runs]
    before, got = b"", []
    for _, _, key, shared in suffixes.merge(packed):
        assert shared == suffixes._shared(before, key, 0)
        before = key
        got.append(key)
    assert got == sorted(k for r in runs for k in r)


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", PROBE), (1, 1, "assistant", "a \\ b [\\INST] <s> <</s>> \\\n"), (1, 1, "assistant", "twice"), (1, 1, "assistant", "twice"),
             (2, 0, None, None), (2, None, "system", "[/INST]</s>"), (None, 5, "assistant", "")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.final_messages(chat.turn_events(rows)))
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.learned) for r in formatted.select(
        "conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    assert got == {
        1: ([("user", PROBE), ("assistant", turns[1][3]), ("assistant", "twice"), ("assistant", "twice")], turns[1][3] + "twicetwice"),
        2: ([("system", "[/INST]</s>"), ("", "")], ""), None: ([("assistant", "")], "")}


def test_chat_folds_events(spark):
    log = [("c", 1, 1, "message", "user", "hel"), ("c", 1, 2, "delta", "user", "lo"), ("c", 2, 3, "message", "assistant", ""),
           ("c", 2, 4, "delta", "assistant", "bad"), ("c", 2, 5, "regenerate", "assistant", ""), ("c", 2, 7, "delta", "assistant", "od"),
           ("c", 2, 6, "delta", "assistant", "go"), ("c", 1, 8, "edit", "user", "hello!"), ("c", 2, 9, "seen", "assistant", "ignored"),
           ("d", 1, 1, "delta", None, "only")]
    events = spark.createDataFrame(log, "conv_id string, msg int, seq int, kind string, role string, text string").repartition(4)
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.final_messages(events).collect()}
    assert got == {"c": [("user", "hello!"), ("assistant", "good")], "d": [("", "only")]}


def test_toxicity(spark):
    rng = np.random.default_rng(9)
    prose = lambda: " ".join(rng.choice("river stone walks under green table light often".split(), size=40))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        bad = [str(w) if toxic else "" for w in rng.choice(["morlock", "snarfer", "grizbul"], 3)]
        rows.append((i, f"{prose()} {bad[0]} {prose()} {bad[1]} {prose()} {bad[2]} {prose()}"))
        labels.append((i, int(toxic)))
    labels += [(1, None), (None, 1), (10_000, 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
    tests = [(1, prose() + " morlock " + prose() + " snarfer"), (2, prose() + prose()), (3, prose() + " M0RL0CK " + prose() + " snаrfer " + prose()), (4, None), (5, "")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), lexicon).collect()}
    assert got[1] > 0.5 and got[3] > 0.5 and max(got[2], got[4], got[5]) < 0.5


def test_toxicity_exceptions_and_no_labels(spark):
    lexicon = toxicity.Lexicon({" trash ": 5.0}, (-4.0, 3.0, 0.0, 3.0))
    matcher = toxicity.Matcher(lexicon)
    assert matcher.score("you trash") > 0.5 > matcher.score("the trash can is full")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    empty = toxicity.learn(spark.createDataFrame([(1, "x")], "doc_id long, text string"), none)
    assert toxicity.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), empty).first().score < 1e-6


def plain_score(text, lexicon):
    """Every place of every term by comparison, phrase by phrase."""
    folded = toxicity.fold(text)
    places = lambda term: [i for i in range(len(folded)) if folded.startswith(term, i)]
    spared = [(i, i + len(p) + 2) for p in lexicon.exceptions for i in places(f" {p} ")]
    words = fragments = 0.0
    for term, weight in lexicon.weights.items():
        for i in places(term):
            if not any(a <= i and i + len(term) <= b for a, b in spared):
                whole = folded[i] == " " and folded[i + len(term) - 1] == " "
                words, fragments = words + weight * whole, fragments + weight * (not whole)
    length = max(60, len(folded)) / 100
    c = lexicon.curve
    return 1 / (1 + np.exp(-np.clip(c[0] + c[1] * words / length + c[2] * fragments / length + c[3] * np.log1p(words + fragments), -500, 500)))


def test_toxicity_equals_plain_scores(spark, awkward):
    lexicon = toxicity.Lexicon({" word ": 1.5, "ord wor": 0.5, " hunter ": 2.0, "xxxxxxx": 0.25, " trash ": 1.0, " ca": 0.75, "nicode": 1.25},
                               (-2.0, 0.5, 0.25, 0.75))
    rows = AWKWARD + [(20, "trash can trash Trаsh cans 7rash\ncan", "a", "a", "a", "a"), (21, "ＷＯＲＤ w0rd", "a", "a", "a", "a")]
    scored = toxicity.score(spark.createDataFrame(rows, SCHEMA), lexicon, score_col="p")
    assert scored.columns == [*awkward.columns, "p"]
    got = by_input((r.doc_id, round(r.p, 9)) for r in scored.collect())
    assert got == by_input((r[0], round(float(plain_score(text_of(r), lexicon)), 9)) for r in rows)


def test_toxicity_lexicon_equals_plain_counts(spark):
    """Weights come from the numbers of texts with a term, and no term that passes the thresholds is missing."""
    rng = np.random.default_rng(12)
    words = [f"{a}{b}" for a in "stone river walk green snarf grizb morl".split() for b in ("", "er", "ul", "ock")]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        some = rng.choice(words[:16] + words[16:] * (2 * toxic), size=12).tolist()
        rows.append((i, " ".join(some * (40 if i % 10 == 0 else 1))))
        labels.append((i, int(toxic)))
    n, least_count, least_weight = 7, 5, 1.2
    lexicon = toxicity.learn(spark.createDataFrame(rows + rows[:1], "doc_id long, text string"), spark.createDataFrame(labels + labels[:9], "doc_id long, toxic int"),
                             n=n, least_count=least_count, least_weight=least_weight)
    counts, sizes = {}, [0, 0]
    for (i, text), (_, toxic) in zip(rows + rows[:1], labels + labels[:1]):
        crc = zlib.crc32(str(i).encode())
        if crc % 5 == 0 or crc % 4 == 0:
            continue
        folded = toxicity.fold(text)
        sizes[toxic] += len(text)
        for term in {f" {w} " for w in folded.split()} | {folded[k:k + n] for k in range(len(folded) - n + 1)}:
            counts.setdefault(term, [0, 0])[toxic] += 1
    weight = {t: np.log((b + 0.5) / sizes[1]) - np.log((a + 0.5) / sizes[0]) for t, (a, b) in counts.items() if b >= least_count}
    want = {t: w for t, w in weight.items() if w >= least_weight}
    assert want and lexicon.weights == pytest.approx(want)


def test_empty_tables(spark, nothing):
    import public_tokenizers

    items = spark.createDataFrame([], "item_id long, text string")
    assert pii.find(nothing).count() == 0
    assert secrets.findings_by_path(nothing).count() == 0
    assert sentencepieces.encode(nothing, tokenizer_path(PIECES)).count() == 0
    assert token_counts.section_tokens(nothing, tokenizer_path(BYTES), public_tokenizers.PATTERN).count() == 0
    assert winnow.decontaminate(nothing, items).count() == 0
    assert suffixes.remove_repeats(nothing).count() == 0
    assert toxicity.score(nothing, toxicity.Lexicon()).count() == 0
    assert chat.final_messages(spark.createDataFrame([], "conv_id long, msg int, seq int, kind string, role string, text string")).count() == 0


def test_agendas_that_advance_together_equal_heaps():
    rng = np.random.default_rng(6)
    vocab = sentencepieces.vocabulary(tokenizer_path(PIECES))
    letters = list("aeinrst▁hdlTHE.,é🙂\x00—日") + ["the", "▁an", "ing"]
    stretches = ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(3_000)] + ["a" * 63, "🙂" * 9, "\x01", "▁" * 30]
    assert vocab._merge_together(stretches) == [vocab._merge_long(s) for s in stretches]
    assert vocab._merge_together([]) == []


def test_generations_of_stretches_change_nothing(monkeypatch):
    monkeypatch.setattr(sentencepieces, "CACHE", 3)
    vocab = sentencepieces.Vocabulary(tokenizer_path(PIECES))
    texts = [f"word{i % 7} and {i} other\nlines  {i % 3} é" for i in range(40)]
    for i in range(0, 40, 4):
        for text, (spelled, decoded, agrees) in zip(texts[i:i + 4], vocab.encode(texts[i:i + 4])):
            ids = vocab.library.encode(text, add_eos=True)
            assert agrees and spelled.split() == list(map(str, ids)) and decoded == vocab.library.decode(ids)
    assert len(vocab.known) < 20


def test_a_conversation_of_many_turns_takes_linear_time(spark):
    import time

    def seconds(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                     F.concat(F.lit("turn "), F.col("id"), F.lit(" </s> with a text of some length and 🙂")).alias("text"))
        begin = time.perf_counter()
        formatted = chat.render(chat.final_messages(chat.turn_events(rows)))
        got = formatted.select(F.size(chat.parse(F.col("formatted"))).alias("n"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("learned")).first()
        assert got.n == n and got.learned == "".join(f"turn {i} </s> with a text of some length and 🙂" for i in range(1, n, 2))
        return time.perf_counter() - begin

    seconds(100)
    assert seconds(32_000) < 10 + 4 * seconds(8_000)


def test_texts_under_one_id_keep_the_same_bytes_in_any_layout(spark):
    """Of different texts with one id the one with the least digest stays whole."""
    shared = "".join(f"{i:03d}," for i in range(40))
    texts = [f"{i} {shared} {i * 7}" for i in range(8)]
    least = min(texts, key=lambda t: hashlib.md5(t.encode()).digest())
    results = []
    for parts, spread in ((1, 1), (4, 3), (200, 8)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            df = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").repartition(spread)
            rows = suffixes.remove_repeats(df).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        results.append(sorted(r.kept_sha256 for r in rows))
        assert [r.kept_sha256 for r in rows if r.n_removed == 0] == [hashlib.sha256(least.encode()).hexdigest()]
    assert results[0] == results[1] == results[2]
