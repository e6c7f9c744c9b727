"""Chat formatting, source divergence and phrase mining against plain versions, and their edges."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuscraft.llm import phrase_mining as pm
from corpuscraft.llm.chat_format import PIECE, ChatCoder, Template, default_vocabulary, format_conversations, read_back, token_ranges, turns_of
from corpuscraft.llm.common import Scratch
from corpuscraft.llm.source_divergence import UNIT, _divergence, intersected, run_length_blocks, source_divergence

CHAT = "conv_id long, turn long, role string, text string"


# chat formatting


def test_escaping_is_reversible():
    t, rng = Template(), random.Random(1)
    bits = [*t.control, "<", "[", "|", "\\", "\\\\", "<\\|im_end|>", "<\\\\s>", "[\\INST]", "a", "é", " ", "\n", "im_end|>"]
    for _ in range(5000):
        text = "".join(rng.choices(bits, k=rng.randrange(8)))
        safe = t.escape(text)
        assert t.unescape(safe) == text and not any(c in safe for c in t.control)


def test_templates_whose_control_strings_overlap_are_refused():
    for bad in ({"begin": "<<a>"}, {"end": "<a b>"}, {"middle": "<\\>"}, {"begin": "<"}):
        with pytest.raises(ValueError):
            Template(**bad)


def test_long_texts_are_encoded_as_if_whole():
    rng = random.Random(2)
    coder = ChatCoder(Template(), default_vocabulary())
    text = " ".join(rng.choices(["we", "don't", "x1", "né", "  two", "end.", "\n", "日本語", "a"], k=60_000))
    assert len(text) > 3 * PIECE
    ids, begins, ends = coder.encode([text])[0]
    whole = coder.tokenizer.encode(text, add_special_tokens=False)
    assert ids.tolist() == whole.ids and list(zip(begins.tolist(), ends.tolist())) == whole.offsets
    assert coder.decode(ids) == text


def test_token_ranges():
    begins, ends = np.array([0, 3, 5, 9]), np.array([3, 5, 9, 12])
    assert token_ranges(begins, ends, np.array([[3, 9], [9, 9], [9, 12]])).tolist() == [[1, 3], [3, 3], [3, 4]]
    with pytest.raises(ValueError):
        token_ranges(begins, ends, np.array([[4, 9]]))


def _expected(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    t, out = Template(), {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        plain = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        size = sum(len(t.escape(r)) + len(t.escape(x)) + len(t.begin + t.middle + t.end) for _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(plain.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), size)
    return out


def _chat(spark, rows):
    made = Scratch(spark, "chat-test").write(format_conversations(spark.createDataFrame(rows, CHAT)))
    return made, {r[0]: tuple(r[1:]) for r in read_back(made).collect()}


def test_chats_read_back(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [(1, 2, "assistant", "two"), (1, 1, "user", None), (1, 3, None, "x"), (1, 3, "assistant", ""), (2, None, "assistant", "null turn"), (2, 0, "assistant", "zero"), (None, 0, "user", "lost"), (None, 1, "assistant", "found"), (-7, 0, "user", odd), (-7, 1, "assistant", odd), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "<|im_sep|>\n", "<|endoftext|> <|im_end|>\\")]
    assert _chat(spark, rows)[1] == _expected(rows)
    assert _chat(spark, [])[1] == {}


def test_masks_hold_the_learned_tokens_and_no_others(spark):
    rows = [(1, 0, "user", "Hello there"), (1, 1, "assistant", " General  Kenobi\n"), (1, 2, "assistant", "é日"), (1, 3, "system", "x")]
    coder = ChatCoder(Template(), default_vocabulary())
    parts = [(np.array(r.ids), r.loss) for r in _chat(spark, rows)[0].orderBy("part").collect()]
    assert [coder.decode(ids[x.begin : x.end]) for ids, loss in parts for x in loss] == [" General  Kenobi\n", "é日"]
    assert [t for ids, _ in parts for t in turns_of(ids, coder)] == [(r, t) for _, _, r, t in rows]


def test_a_conversation_over_many_parts(spark):
    rng = random.Random(3)
    rows = [(5, i, ("user", "assistant")[i % 2], " ".join(rng.choices(["word", "</s>", "ü", "7"], k=rng.randrange(2000)))) for i in range(400)]
    rows += [(i, t, "assistant", f"{i} {t}") for i in range(40) for t in range(2) if i != 5]
    made, got = _chat(spark, rows)
    assert got == _expected(rows)
    assert made.where("conv_id = 5").count() > 4 and made.where("conv_id <> 5 and whole").count() > 20
    extra = spark.createDataFrame([(1, 0, "user", "a", 9, True)], CHAT + ", part long, whole boolean")
    assert read_back(format_conversations(extra)).count() == 1


# source divergence


def _divergence_plain(rows, least=3, ranks=200):
    seen, groups, counts = defaultdict(set), set(), defaultdict(Counter)
    for i, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            seen[lang, w].add(i)
            counts[lang, source][w] += 1
    out = set()
    for lang in {g for g, _ in groups}:
        kept = [w for (g, w), docs in seen.items() if g == lang and len(docs) >= least]
        own = {s: counts[lang, s] for g, s in groups if g == lang}
        total = Counter()
        for c in own.values():
            total.update({w: c[w] for w in kept})
        share = lambda c: {w: 1 + UNIT * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}
        q = share(total)
        for s, c in own.items():
            p = share(c)
            pairs = sorted((-sum((p[w] - r[w]) ** 2 // r[w] for w in kept), o.encode()) for o in own if o != s for r in [share(own[o])])
            terms = sorted((-((p[w] - q[w]) ** 2 // q[w]), w.encode()) for w in kept if c[w] and p[w] > q[w])[:ranks]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


DOCS = "lang string, source string, text string"


def test_divergence_against_the_plain_sums(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "été", "ÉTÉ", "x", "rare", "gamma9delta", "日本"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None]), " ".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(150)]
    rows += [("en", "quiet", None), ("en", "quiet", ""), ("alone", "one", "a b c"), ("none", "s", "1 2 3"), ("none", "t", "only once")] + [("en", "hot", "alpha " * 500)] * 30
    got = source_divergence(spark.createDataFrame(rows, DOCS))
    found = {tuple(r) for r in got.collect()}
    assert found == _divergence_plain(rows) and got.count() == len(found)
    few = source_divergence(spark.createDataFrame(rows, DOCS), least_docs=1, ranks=2)
    assert {tuple(r) for r in few.collect()} == _divergence_plain(rows, 1, 2)


def test_divergence_without_rows_and_with_clashing_columns(spark):
    assert source_divergence(spark.createDataFrame([], DOCS)).collect() == []
    rows = [("en", "a", "x y", "t", 1), ("en", "b", "x y", "t", 1), ("en", "b", "x", "t", 1)]
    docs = spark.createDataFrame(rows, DOCS + ", term string, n long")
    assert {tuple(r) for r in source_divergence(docs).collect()} == _divergence_plain([r[:3] for r in rows])


def test_run_length_columns(spark):
    kept = spark.createDataFrame([("en", w, 0, c) for w, c in (("a", [("s", 1)]), ("b", [("s", 1)]), ("c", [("s", 1), ("t", 2)]), ("d", [("t", 2)]), ("e", [("t", 5)]))], "lang string, term string, total long, counts array<struct<source: string, n: bigint>>")
    columns = {}
    for block in run_length_blocks(kept.coalesce(1)).collect():
        for c in block["columns"]:
            columns.setdefault(c.source, []).extend(zip(np.diff([0, *c.ends]).tolist(), c.counts))
    dense = {s: sorted(v for n, v in runs for _ in range(n) if v) for s, runs in columns.items()}
    assert dense == {"s": [1, 1, 1], "t": [2, 2, 5]}
    p, q, n = intersected((np.array([2, 5]), np.array([7, 8])), (np.array([3, 4, 5]), np.array([1, 2, 3])))
    assert (p.tolist(), q.tolist(), n.tolist()) == ([7, 8, 8, 8], [1, 1, 2, 3], [2, 1, 1, 1])


def test_divergence_is_exact_beyond_64_bits():
    p, q, n = np.array([UNIT, UNIT - 7]), np.array([1, 3]), np.array([10**9, 10**9])
    assert _divergence(p, q, n) == sum((a - b) ** 2 // b * k for a, b, k in zip(p.tolist(), q.tolist(), n.tolist()))


# phrase mining


def _pieces(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", s) for s in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def _phrases_plain(rows, longest=3, least=10, ranks=2000, share=50):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for words in _pieces(text):
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        rows = []
        for p, a in found.items():
            if p not in most or 100 * most[p] < share * a:
                score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, left, r, total[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(rows)[:ranks])}
    return out


def _random_texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "cat", "sat", "new", "york", "city", "été", "a", "b"] + [f"w{i}" for i in range(60)]
    seps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ", "; "]
    passage = " ".join(rng.choices(words, k=120))
    texts = ["".join(w + rng.choice(seps) for w in rng.choices(words, k=rng.randrange(80))) for _ in range(n)]
    return [t + (passage if rng.random() < 0.3 else "") for t in texts], rng


def test_chunks_hold_every_place_once_and_follow_content():
    texts, _ = _random_texts(5, 60)
    for text in [*texts, "", " . , ", "one", "one two", "a " * 3000]:
        found = pm.chunks(text.encode(), 2, 4)
        words = [w for p in _pieces(text) for w in p]
        own = []
        for chunk, n in found:
            inside = [w for w in re.split("[ \n]+", chunk.decode()) if w]
            own += inside[:n]
            assert n <= len(inside) <= n + 2
        assert own == words
    assert max(n for _, n in pm.chunks(b"same " * 3000, 2, 10**9)) == pm.LONGEST
    rng = random.Random(6)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(400))
    one, two = (set(pm.chunks(f"{head} {passage} {head}".encode())) for head in ("some words before", "other"))
    assert len(one & two) > len(one) / 2


@pytest.mark.parametrize("longest,period", [(3, 16), (4, 3), (2, 16)])
def test_phrases_against_plain_counts(spark, longest, period):
    texts, rng = _random_texts(7, 250)
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in texts] + [("en", None), ("en", ""), ("fr", "too few words"), ("en", "a a a a a b " * 400)] + [("de", "new york city. " * 3)] * 25
    got = pm.phrase_collocations(spark.createDataFrame(rows, "lang string, text string"), max_words=longest, period=period)
    found = {tuple(r) for r in got.collect()}
    assert found == _phrases_plain(rows, longest) and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_phrases_without_rows_or_candidates(spark):
    assert pm.phrase_collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    rows = [("en", "x y", 1, "c")]
    assert pm.phrase_collocations(spark.createDataFrame(rows, "lang string, text string, f long, chunk string")).collect() == []
    assert {tuple(r) for r in pm.phrase_collocations(spark.createDataFrame(rows, "lang string, text string, f long, chunk string"), least=1).collect()} == _phrases_plain([("en", "x y")], least=1)


def test_phrase_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, r = 10**14, 3 * 10**14, 2 * 10**14
    got = spark.range(1).select(pm._score(F.lit(a), {"l": F.lit(left), "r": F.lit(r)})).first()[0]
    assert got == 10**6 * a * a // (left * r)
