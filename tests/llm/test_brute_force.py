"""Operators that SQL can't express, beside plain Python that does the same another way."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boutforge.llm import bpe, kneser_ney, mixing, pii, queries, secrets, superminhash, tables, toxicity

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# 2


def base_secrets(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[1], secrets.BASE.index(x[0])))


def test_secrets_query_finds_the_base_spans(spark, documents):
    rows = queries.op2_secrets(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        want = base_secrets(documents[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in want) for x in secrets.BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(filter(None, r.spans.split(",")))


def upper_tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def plain_battery(token):
    """(stratum, p, words) of a token by the tests' definitions, or None."""
    kinds = [bool(re.search(p, token)) for p in ("[0-9]", "[a-z]", "[A-Z]")]
    bare = token.rstrip("=")
    if sum(kinds) == 3:
        code = "base64"
    elif sum(kinds) < 2:
        return None
    elif re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        code = "hex"
    elif re.fullmatch("[A-Z2-7]+=*", token):
        code = "base32"
    elif re.fullmatch("(?:[0-9a-z]+|[0-9A-Z]+)=*", token):
        code = "base36"
    elif re.fullmatch("[A-Za-z]+=*", token):
        code = "base62"
    else:
        return None
    if len(token) < secrets.SHORTEST[code]:
        return None
    alphabet = secrets.ALPHABETS[code]
    plain = bare.translate(str.maketrans("-_", "+/")) if code == "base64" else bare.lower() if code in ("hex", "base36") else bare
    at = [alphabet.index(c) for c in plain]
    n, k = len(at), len(alphabet)
    chi = sum((c - n / k) ** 2 / (n / k) for c in collections.Counter(at).values()) + (k - len(set(at))) * n / k
    free = 2 / (9 * (k - 1))
    p = [upper_tail(((chi / (k - 1)) ** (1 / 3) - (1 - free)) / math.sqrt(free))]
    above = [2 * x >= k for x in at]
    high = sum(above)
    mean = 2 * high * (n - high) / n + 1
    runs = 1 + sum(x != y for x, y in itertools.pairwise(above))
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    p.append(0.5 ** (n - 1) if high in (0, n) else 2 * upper_tail(abs(runs - mean) / spread))
    centred = [x - (k - 1) / 2 for x in at]
    p.append(2 * upper_tail(abs(sum(x * y for x, y in itertools.pairwise(centred)) / max(sum(x * x for x in centred), 1e-9)) * math.sqrt(n)))
    if code == "base36":
        p.append(2 * upper_tail(abs(sum(x < 10 for x in at) - n * 10 / 36) / math.sqrt(n * 260 / 1296)))
    uneven = secrets.WORDS[code] * n
    words = upper_tail((k - 1 + uneven - chi) / math.sqrt(2 * (k - 1) + 4 * uneven))
    band = sum(len(token) >= x for x in secrets.LENGTHS[:-1])
    return f"{code}/{band}", min(1, len(p) * min(p)), words


def plain_secrets(tokens):
    """The tokens that two step-ups in each stratum call secrets, with p-values in the bins that the operator uses."""
    bin_of = lambda p: min(int(p**0.25 * secrets.BINS), secrets.BINS - 1)
    tested = {t: b for t in tokens if (b := plain_battery(t))}
    out = set()
    for stratum in {b[0] for b in tested.values()}:
        own = {t: b for t, b in tested.items() if b[0] == stratum}
        limits = []
        for which in (1, 2):
            bins = sorted(bin_of(b[which]) for t in tokens if t in own for b in [own[t]])
            passed = [b for b in set(bins) if ((b + 1) / secrets.BINS) ** 4 <= secrets.ALPHA * sum(x <= b for x in bins) / len(bins)]
            limits.append(max(passed, default=-1))
        out |= {t for t, b in own.items() if bin_of(b[1]) > limits[0] and bin_of(b[2]) <= limits[1]}
    return out


def planted_tokens():
    rng = random.Random(11)
    alphabet = secrets.ALPHABETS["base64"][:62]
    parts = ["Config", "Service", "Handler", "Default", "Options", "Factory", "Bean", "Internal", "Manager", "Request", "Parser", "Client", "Store", "Value2", "Item3", "user", "name", "list"]
    wordy = ["".join(rng.choice(parts) for _ in range(rng.choice([4, 5, 7]))) for _ in range(900)]
    random_ = ["".join(rng.choices(alphabet, k=n)) for n in (24, 36, 48, 80) for _ in range(25)]
    random_ += ["".join(rng.choices("0123456789abcdef", k=n)) for n in (28, 30) for _ in range(10)]
    return wordy, random_


def test_battery_and_step_ups_match_plain_python(spark):
    wordy, random_ = planted_tokens()
    tokens = wordy + random_
    docs = spark.createDataFrame([(k, f"x: {t} end") for k, t in enumerate(tokens)], "doc_id long, text string")
    got = {r.doc_id for r in secrets.find(docs).collect() if r.secrets}
    want = plain_secrets(tokens)
    assert got == {k for k, t in enumerate(tokens) if t in want}


def test_planted_secrets_by_length(spark):
    """Of long random tokens few are missed; of what is called a secret few are words."""
    wordy, random_ = planted_tokens()
    found = plain_secrets(wordy + random_)
    for length in (36, 48, 80):
        own = [t for t in random_ if len(t) == length]
        assert sum(t in found for t in own) >= 0.9 * len(own), length
    assert sum(t in found for t in wordy) <= 0.1 * len(found)


# 4


def base_pii(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_personal_data_query_finds_the_base_spans(spark, documents):
    for r in queries.op4_pii(spark, SF).collect():
        want = base_pii(documents[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(filter(None, r.spans.split(",")))


def plain_score(kind, text, a, b):
    around = (text[max(0, a - pii.WINDOW) : a] + " " + text[b : b + pii.WINDOW]).lower()
    near = lambda p: re.search(rf"(?<![^\W_])(?:{p})", around) is not None
    return min(1.0, max(0.0, pii.PRIOR[kind] + pii.BONUS * near(pii.CONTEXT[kind]) - pii.MALUS * near(pii.AGAINST)))


def added_pii(text):
    found = []
    for kind, pattern in ((k, pii.PATTERNS["card" if k == "short_card" else k]) for k in pii.ADDED):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "iban":
                plain = m[0].replace(" ", "")
                good = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
            elif kind == "short_card":
                good = 13 <= len(digits) <= 15 and luhn(digits)
            elif kind == "local_phone":
                good = 8 <= len(digits) <= 12
            else:
                good = not re.match("000|666|9", m[0])
            if good and plain_score(kind, text, *m.span()) >= pii.KEEP:
                found.append((kind, *m.span()))
    return found


def test_added_kinds_and_scores(spark):
    iban, bad_iban = "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01"
    amex, bad_amex = "3782 822463 10005", "3782 822463 10006"
    pieces = [iban, bad_iban, amex, bad_amex, "030 1234 5678", "(0170) 123-45678", "123-45-6789", "000-12-3456", "912-34-5678", "a@b.org", "10.0.0.1", "+1 204 555 0188", "4539 1488 0343 6467"]
    near = ["", "bank ", "hotel ", "tel ", "telefon ", "script ", "ip ", "order ", "invoice: ", "card no. ", "discard ", "syntax ", "tax ", "ssn ", "mobile ", "version "]
    rng = random.Random(3)
    texts = [f"{a}{p}" for a in near for p in pieces]
    texts += ["é" * rng.randint(0, 30) + " " + " / ".join(rng.choice(near) + rng.choice(pieces) for _ in range(6)) for _ in range(150)]
    rows = pii.find(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_pii(r.text) + added_pii(r.text)
        assert [(s.kind, s.start, s.end) for s in r.pii] == want, r.text
        assert all(abs(s.score - plain_score(s.kind, r.text, s.start, s.end)) < 1e-9 for s in r.pii), r.text
    assert {k for r in rows for k in (s.kind for s in r.pii)} == {*pii.BASE, *pii.ADDED}


# long texts and odd columns


@pytest.mark.parametrize("piece", ["u{}@x.org ", "10.0.{}.7 ", "4539 1488 0343 6467 x{} ", "+1 204 555 01{} ; ", "DE89 3704 0044 0532 0130 00 {} ", "word{} "])
def test_very_long_texts_of_personal_data(spark, piece):
    text = "".join(piece.format(k % 90 + 10) for k in range(1_000_000 // len(piece)))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii] for r in pii.find(docs).collect()}
    assert time.time() - began < 60
    assert got[2] == got[3] == []
    assert [x for x in got[1] if x[0] in pii.BASE] == base_pii(text)


def test_very_long_texts_of_secrets(spark):
    rng = random.Random(1)
    tokens = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=30)) for _ in range(8000)]
    text = " ".join(f"token={t}" if k % 2 else t for k, t in enumerate(tokens)) + " " + "0123456789abcdef" * 20_000
    began = time.time()
    got = secrets.find(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert time.time() - began < 120 and len(got) == 2
    assert [(s.kind, s.start, s.end) for s in got[0].secrets if s.kind != "random"] == base_secrets(text)


def test_columns_of_any_name_survive(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org token=abcdefgh12 the end", "en", "s", "t", "l", "d", "c")], "doc_id long, text string, lang string, source string, __text string, __lang string, __DIGIT string, ___candidate string")
    for out in (pii.find(docs), secrets.find(docs), mixing.mix(docs), bpe.encode(docs, queries.TOKENIZER, decoded="decoded"), bpe.decode(bpe.encode(docs, queries.TOKENIZER), queries.TOKENIZER), toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")))):
        row = out.first()
        assert [row[c] for c in docs.columns] == list(docs.first()), out.columns
    model = kneser_ney.train(docs, order=3)
    assert kneser_ney.score(docs, model, keep=["__text"]).first()["__text"] == "t"


# 3


def test_groups_of_outliers_in_many_cells(spark, monkeypatch):
    """Copies of copies that drift from their hub, in blocks of a few classes."""
    monkeypatch.setattr(superminhash, "CELL_CLASSES", 3)
    monkeypatch.setattr(superminhash, "PASSING_CLASSES", 5)
    monkeypatch.setattr(superminhash, "PASSING_AT_ONCE", 2)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(500)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    texts = {}
    for k in range(60):
        if k % 6 == 0:
            words = list(base)
        for _ in range(rng.choice([2, 3, 9])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts[k] = " ".join(words)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
    for percent in (80, 85):
        label = {i: i for i in texts}
        for _ in texts:
            for a, b in itertools.combinations(texts, 2):
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    label[a] = label[b] = min(label[a], label[b])
        got = {r.doc_id: r.component_id for r in superminhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent=percent).collect()}
        assert got == label, percent
        assert 1 < len(set(label.values())) < 40


# 8


class PlainKneserNey:
    """Interpolated modified Kneser-Ney of order 3 by dictionaries."""

    def __init__(self, texts):
        self.triples = collections.Counter()
        for t in texts:
            w = ["<s>", "<s>", *words_of(t), None]
            self.triples.update(zip(w, w[1:], w[2:]))
        self.pairs, self.words = collections.Counter(), collections.Counter()
        for (_, v, w), n in self.triples.items():
            self.pairs[v, w] += n if v == "<s>" else 1
        for _, w in self.pairs:
            self.words[w] += 1
        self.d3, self.d2, self.d1 = (self.discounts(x) for x in (self.triples, self.pairs, self.words))
        self.followers3, self.followers2 = collections.defaultdict(list), collections.defaultdict(list)
        for (u, v, _), n in self.triples.items():
            self.followers3[u, v].append(n)
        for (v, _), n in self.pairs.items():
            self.followers2[v].append(n)

    @staticmethod
    def discounts(counts):
        return kneser_ney._discounts(np.array([sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)]))

    @staticmethod
    def level(n, followers, d, lower):
        if not followers:
            return lower
        gamma = sum(d[min(x, 3)] for x in followers) / sum(followers)
        return max(n - d[min(n, 3)], 0) / sum(followers) + gamma * lower

    def p(self, u, v, w):
        low = self.level(self.words[w], list(self.words.values()), self.d1, 1 / (len(self.words) + 1))
        return self.level(self.triples[u, v, w], self.followers3[u, v], self.d3, self.level(self.pairs[v, w], self.followers2[v], self.d2, low))

    def score(self, text):
        w = ["<s>", "<s>", *words_of(text), None]
        return sum(math.log10(self.p(*x)) for x in zip(w, w[1:], w[2:]))


def test_triples_match_dictionaries(spark, documents):
    texts = {i: t for i, t in list(documents.items())[:60]} | {-1: None, -2: "", -3: "neverseen word The the", -4: "a a a a b a a"}
    learnt = [t for i, t in texts.items() if i % 5]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    plain = PlainKneserNey(learnt)
    model = kneser_ney.train(docs.where("doc_id % 5 <> 0"), order=3)
    for r in kneser_ney.score(docs, model).collect():
        assert abs(r.score - plain.score(texts[r.doc_id])) < 1e-6 * max(1, abs(r.score)), r.doc_id
    for context in (("<s>", "<s>"), ("<s>", "the"), ("unheard", "the")):
        total = sum(plain.p(*context, w) for w in plain.words) + plain.p(*context, "unheard")
        assert abs(total - 1) < 1e-9


def test_many_equal_triples_are_counted(spark):
    docs = spark.createDataFrame([(1, "x y z " * 700)], "doc_id long, text string")
    plain = PlainKneserNey(["x y z " * 700])
    assert max(plain.triples.values()) > kneser_ney.MANY
    row = kneser_ney.score(docs, kneser_ney.train(docs, order=3)).first()
    assert abs(row.score - plain.score("x y z " * 700)) < 1e-6


def test_language_model_query(spark, documents):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in documents}
    counts = collections.Counter(w for i, t in documents.items() if not held[i] for w in [*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    rows = queries.op8_kneser_ney(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(documents)
    better = []
    for r in rows:
        w = [*words_of(documents[r.doc_id]), None]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in counts for x in w), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        better.append(r.score > r.base_score)
    assert np.mean(better) > 0.9


# 7 and 9


def test_recall_of_the_registered_search(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = collections.defaultdict(set)
    for r in queries.op7_hilbert(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for i in ids[ids % 20 == 0]:
        s = m @ m[np.flatnonzero(ids == i)[0]]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]
        hits.append(len(got[i] & set(ids[best].tolist())) / len(best))
    assert np.mean(hits) >= 0.9


def test_repeated_ids_with_different_vectors(spark):
    from boutforge.llm import hilbert, topk

    rows = [(k, [float(k), 1.0]) for k in range(40)] + [(20, [5.0, 5.0]), (20, [5.0, 5.0]), (7, [-3.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for search in (topk.search, hilbert.search):
        found = search(table).collect()
        assert {r.query_id for r in found} == {0, 20}
        assert all(r.vec_id != r.query_id for r in found)


def test_files_query(spark, documents):
    library = Tokenizer.from_file(queries.TOKENIZER)
    start, want = 0, {}
    for i in sorted(documents):
        ids = [*library.encode(documents[i], add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_rans(spark, SF).collect()} == want


# 10


def test_viterbi_finds_the_cheapest_of_all_paths():
    rng = random.Random(2)
    text = ("the stupid idiot and the loser read that " * 40).encode()
    c = np.concatenate([[0, 0], toxicity._CLASS[np.frombuffer(text, np.uint8)]])
    counts = np.zeros(toxicity.CLASSES**3, np.int64)
    np.add.at(counts, (c[:-2] * toxicity.CLASSES + c[1:-1]) * toxicity.CLASSES + c[2:], 1)
    model = toxicity.CharacterModel(counts)

    def cost(path):
        classes = [0, 0, *(k for a, _ in path for k in toxicity._classes(a)), 0]
        return sum(extra for _, extra in path) + sum(model.table[x][y][z] for x, y, z in zip(classes, classes[1:], classes[2:]))

    for _ in range(200):
        word = "".join(rng.choice("stupid01$!.-@e") for _ in range(rng.randint(1, 6)))
        units = toxicity.lattice(word)
        least = min(cost(path) for path in itertools.product(*units))
        found = toxicity.decode(units, model, {len(units)})[0]
        assert any("".join(a for a, _ in path) == found and abs(cost(path) - least) < 1e-9 for path in itertools.product(*units)), word


def test_held_out_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    n = collections.Counter((r.toxic, r.predicted) for r in queries.op10_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect())
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85 and n[1, 1] / (n[1, 1] + n[0, 1]) > 0.95


def test_every_operator_takes_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, "")], "doc_id long, text string")
    model = kneser_ney.train(docs, order=3)
    assert kneser_ney.score(docs, model).count() == 4 and kneser_ney.score(docs.limit(0), model).count() == 0
    assert pii.find(docs).count() == secrets.find(docs).count() == bpe.encode(docs, queries.TOKENIZER).count() == 4
    assert tables.unused(["a", "__b", "___C"]) == "____"
    assert docs.where(F.col("doc_id") == 1).count() == 2
