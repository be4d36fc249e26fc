import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import chat, ctw, langid, licenses, neardup, phrases, rules, toxic
from tidepool.llm.common import annotate, remainder, table
from tidepool.llm.template import CHAT, Template, TemplateError, guard, line, unguard, unline

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, annotation string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """Null and empty texts, repeated rows, null ids, a very long text."""
    return spark.createDataFrame([(1, None, "en", "x"), (2, "", None, "x"), (3, "one two three four five six", "en", "x"), (3, "one two three four five six", "en", "x"), (None, "!!!", "en", None), (5, "lang wort " * 30_000, "de", "x")], DOCS)


def test_remainder(spark):
    got = docs(spark, "a").select(remainder("doc_id", 7).alias("r")).first()["r"]
    assert got == zlib.crc32(b"0") % 7


def test_annotate_keeps_columns(spark):
    out, name = annotate(odd(spark), "text", "n long", lambda part: {"n": [len(x or "") for x in part.column("text").to_pylist()]})
    assert name == "_annotation" and out.columns == ["doc_id", "text", "lang", "annotation", "_annotation"]
    assert out.where("doc_id = 5").first()["_annotation"]["n"] == 300_000


# Decontamination


def test_decontaminate_against_all_windows(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)] + ["the", "Ünd", "x1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([0, 2, 5, 14, 30]))) for i in range(8)] + [(9, None), (10, "...")]
    texts = [say(rng.randrange(60)) for _ in range(60)] + [f"{say(5)}, {items[5][1]}! {say(4)}", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    for n in (13, 2):
        want = phrases.brute_force(list(enumerate(texts)), items, n)
        got = phrases.decontaminate(d, i, n=n).select("doc_id", "n_words", "n_hit", "n_items", phrases.items_digest("items"), "contaminated")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_decontaminate_in_blocks(spark, monkeypatch):
    d = table(spark, DIR, "documents")
    items = table(spark, DIR, "benchmark")
    whole = sorted(tuple(r) for r in phrases.decontaminate(d, items).collect())
    real = phrases.query_blocks
    monkeypatch.setattr(phrases, "query_blocks", lambda *a: real(*a, block_bytes=3000))
    assert sorted(tuple(r) for r in phrases.decontaminate(d, items).collect()) == whole


def test_proximity(spark):
    index = phrases.build_index(docs(spark, "a b c d e", "a x x x x b", "b a", "c"))
    assert {r["key"]: r["n_starts"] for r in phrases.near_matches(index, "a B", 2).collect()} == {0: 1, 2: 1}
    assert {r["key"] for r in phrases.near_matches(index, "a b", 6).collect()} == {0, 1, 2}


def test_decontaminate_odd_rows(spark):
    items = spark.createDataFrame([(None, "two three")], "item_id long, text string")
    got = phrases.decontaminate(odd(spark), items).collect()
    assert len(got) == 6 and sorted(r["n_hit"] for r in got) == [0, 0, 0, 0, 2, 2]
    assert {tuple(r["items"]) for r in got if r["n_hit"]} == {("null",)}
    assert all(r["n_hit"] == 0 for r in phrases.decontaminate(odd(spark), items.where("false")).collect())
    assert phrases.decontaminate(odd(spark).where("false"), items).count() == 0


# Toxicity


def test_gradient():
    texts = [b"you idiot man of war", b"nice day to be here now with you", b"lowei lowo x"] * 3
    net = toxic.train(texts, [1, 0, 1] * 3, rounds=1)
    vocabulary, ids, lens = toxic.numbered(texts[:3])
    at, _ = toxic.windows(lens, ids, len(vocabulary))
    x, y = net.inputs(vocabulary), np.array([1, 0, 1.0])

    def loss():
        logit = net.forward(at, net.gates(net.vectors(x)))
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    gradient, rng = net.gradient(at, y, x), np.random.default_rng(0)
    for name, p in net.p.items():
        flat = p.reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            was = flat[i]
            flat[i] = was + 1e-2
            up = loss()
            flat[i] = was - 1e-2
            numeric, flat[i] = (up - loss()) / 2e-2, was
            assert abs(numeric - gradient[name].reshape(-1)[i]) < 3e-3 + 0.05 * abs(numeric), name


def plain_score(net, text):
    """The recurrence, the attention and the worst window, word by word and number by number."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    p = {k: v.astype(float) for k, v in net.p.items()}
    known = {int(c): i for i, c in enumerate(net.grams.codes) if i}

    def vector(w):
        marked = b"\x02" + w + b"\x03"
        grams = [int.from_bytes(marked[i : i + n], "big") for n in toxic.GRAMS for i in range(len(marked) - n + 1)]
        chars = sum((p["char"][known[g]] for g in grams if g in known), np.zeros(toxic.CHAR_DIM)) / max(len(grams), 1)
        return np.concatenate([p["word"][net.number[w]] if w in net.number else np.zeros(toxic.WORD_DIM), chars])

    def states(xs, side):
        h, out = np.zeros(toxic.HIDDEN), []
        for x in xs:
            gate = x @ p[f"in_{side}"] + p[f"bias_{side}"]
            n = toxic.HIDDEN
            u = h @ p[f"zr_{side}"]
            z, r = sig(gate[:n] + u[:n]), sig(gate[n : 2 * n] + u[n:])
            h = z * h + (1 - z) * np.tanh(gate[2 * n :] + (r * h) @ p[f"n_{side}"])
            out.append(h)
        return out

    w = phrases.words(text.encode())
    best = 0.0
    for i in range(0, max(1, len(w) - toxic.WINDOW + toxic.STRIDE), toxic.STRIDE) if w else ():
        xs = [vector(x) for x in w[i : i + toxic.WINDOW]]
        both = [np.concatenate(s) for s in zip(states(xs, "f"), states(xs[::-1], "b")[::-1])]
        e = np.exp([float(np.tanh(s @ p["att"] + p["att_bias"]) @ p["query"][:, 0]) for s in both])
        pooled = sum(a * s for a, s in zip(e / e.sum(), both))
        best = max(best, float(sig(pooled @ p["out"][:, 0] + p["out_bias"][0])))
    return best


def test_scores_against_plain_loops(spark):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(["you", "idiot", "nice", "day", "Ünd", "scum", "x", "lower"]) for _ in range(n))
    net = toxic.train([say(30).encode() for _ in range(40)], [i % 2 for i in range(40)], rounds=2)
    texts = [say(n) for n in (0, 1, 5, 23, 24, 25, 36, 37, 90)] + ["unseen words only", "!!!"]
    got = toxic.scores(net, [t.encode() for t in texts])
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5)


def test_windows_cover_everything():
    lens = np.array([0, 1, 24, 25, 100])
    at, owner = toxic.windows(lens, np.arange(lens.sum()), -1)
    assert set(at[at >= 0].tolist()) == set(range(lens.sum())) and set(owner) == {1, 2, 3, 4}


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["er", "an", "th", "on", "in", "ti"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(rng.randrange(5, 120))]
        bad = i % 4 == 0
        for _ in range(2 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["moron", "scum", "lowei" + word()]))
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxic.fit(df.where("doc_id < 300"), df.select("doc_id", "toxic").where("doc_id < 300"))
    got = {r["doc_id"]: r for r in toxic.toxicity(df, net).collect()}
    right = [got[i]["predicted"] == bad for i, _, bad in rows if i >= 300]
    assert np.mean(right) >= 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    scores = {r["doc_id"]: r["score"] for r in toxic.toxicity(odd(spark), net).collect()}
    assert scores[1] == scores[2] == 0 and toxic.toxicity(odd(spark).where("false"), net).count() == 0
    one_label = toxic.fit(df, df.select("doc_id", "toxic").where("toxic = 0"))
    assert all(r["predicted"] == 0 for r in toxic.toxicity(odd(spark), one_label).collect())


# Licenses


def slow_scan(text, k=5, percent=80):
    """Every window of every template, without signatures."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    w = phrases.words((text or "").encode())
    runs = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    found = []
    for g, own in licenses._grouped(scanner):
        for _, name, t, _ in own:
            tw = phrases.words(t.encode())
            shingles = {tuple(tw[i : i + k]) for i in range(len(tw) - k + 1)}
            for s in range(0, len(runs), g.step):
                at = [i for i in range(s, min(s + g.size, len(runs))) if runs[i] in shingles]
                common = len({runs[i] for i in at})
                if 100 * common >= percent * len(shingles):
                    found.append((name, common, {*at}))
    return sorted({a[0] for a in found if not any(b[0] != a[0] and b[1] > a[1] and 2 * len(a[2] & b[2]) >= len(a[2]) for b in found)})


def test_licenses(spark):
    rng = random.Random(3)
    some = [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts = [None, "", "mit license"]
    for t in some:
        w = t.split()
        for drop in (0, 1, len(w) // 3):
            cut = [x for i, x in enumerate(w) if i not in rng.sample(range(len(w)), drop)]
            texts.append(" ".join(["lorem"] * rng.randrange(9) + cut + ["ipsum"] * rng.randrange(9)))
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, *texts)).collect()}
    assert got == {i: slow_scan(t) for i, t in enumerate(texts)}
    assert sum(map(bool, got.values())) >= len(some)
    assert licenses.scan_licenses(odd(spark)).count() == 6 and licenses.scan_licenses(odd(spark).where("false")).count() == 0


def test_licenses_that_share_sentences(spark):
    whole = {name: max(own, key=len) for name, own in licenses.TEMPLATES.items()}
    names = sorted(whole)
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, *(f"some words {whole[n]} and more" for n in names))).collect()}
    assert got == {i: [n] for i, n in enumerate(names)}
    both = licenses.scan_licenses(docs(spark, f"{whole['MIT']} {whole['ISC']} Released under the MIT License. {whole['Zlib']}")).first()
    assert both["licenses"] == ["ISC", "MIT", "Zlib"] and both["best"] == 1.0


def test_license_bands():
    s = licenses.Scanner(licenses.TEMPLATES)
    assert len(licenses.TEMPLATES) >= 20 and max(n for n, *_ in s.sized) > 150
    for g, own in licenses._grouped(s):
        for n, *_ in own:
            assert g.size >= n + g.step
            common = -(-80 * n // 100)
            assert (1 - common / (n + g.size - common)) ** g.bands <= 1e-7


# Quality rules


def slow_statistics(text):
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_statistics():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "|", "a b c ", "x\n"]) for _ in range(rng.randrange(60)))
        assert rules.statistics(t.encode())[:5] == slow_statistics(t), t


def test_rules_and_verdicts(spark):
    d, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    learned = rules.fit(d, labels)
    out, at = rules.judge(d, learned)
    got = out.select("doc_id", "text", f"`{at}`.*").collect()
    for r in got:
        n, chars, symbols, dup, repeat = slow_statistics(r["text"] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and r["kept"] == (not r["base_failed"] and r["rule"] == 0)
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    kept = [r["kept"] for r in got if r["doc_id"] in good and not r["base_failed"]]
    assert np.mean(kept) > 0.98
    out, at = rules.judge(odd(spark), [])
    assert {r["doc_id"]: r[at]["kept"] for r in out.collect()} == {1: False, 2: False, 3: False, None: False, 5: False}
    assert rules.fit(d, labels.where("false")) == []


def test_covering():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.1) & (x["a"] < 0.5))
    found = rules.learn(x, bad, np.arange(900) % 3 == 0, most_conditions=3)
    said = np.zeros(900, bool)
    for r in found:
        said |= rules._covers(r, x, 900)
    assert (said == bad).mean() > 0.94 and 1 <= len(found) <= 4


# Chats


def test_template():
    t = Template("{% set a = 1 + 2 %}{{ 'x' ~ 2 if 2 > 1 else 'n' }}{%- for m in messages -%} {% if m.role == 'user' or false %}U:{{ m['text'] | trim }}{% elif not loop.last %}mid{% else %}{% generation %}{{ m.text }}{% endgeneration %}{% endif %};{% endfor %}")
    assert t.render([{"role": "user", "text": " hi "}, {"role": "b", "text": "t"}, {"role": "b", "text": "t2"}]) == ("x2U:hi;mid;t2;", [(11, 13)])
    assert Template("a{{ 'b' | upper }}{% if 1 == 1 %}c{% endif %}{# no #}").tree[0].args == ("aBc",)
    assert Template("{{ '}}' ~ \"%}\" }}{% if x == '%}' %}a{% endif %}").render([], x="%}")[0] == "}}%}a"
    for bad in ("{{ '%999999999d' % 1 }}", "{{ x % 2 }}"):
        with pytest.raises(TemplateError):
            Template(bad).render([], x="%9999d")
    for bad in ("{% if x %}", "{% endif %}", "{{ x( }}", "{{ x.y | nope }}", "{% while x %}", "{{ }}", "{{ 'a }}"):
        with pytest.raises(TemplateError):
            Template(bad)
    with pytest.raises(TemplateError):
        Template("{{ m.text.upper }}").render([], m={"text": "x"})


def test_escapes():
    rng = random.Random(6)
    for _ in range(500):
        x = "".join(rng.choice(["<", "|", "\\", "\n", "n", "<|im_end|>", "a"]) for _ in range(rng.randrange(9)))
        assert unguard(guard(x)) == x and "<|" not in guard(x)
        assert unline(line(x)) == x and "\n" not in line(x) and "<|" not in line(x)


def test_chats(spark):
    rows = [(1, 0, "user", "<|im_end|>\n"), (1, 1, "assistant", None), (1, 2, "assistant", "a<|b"), (2, None, None, "x"), (None, 1, "assistant", "y"), (3, 5, "ro\nle", "z"), (3, 5, "ro\nle", "z")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, part string")
    parts = chat.format_chats(df)
    read = {}
    for r in parts.orderBy("part").collect():
        read.setdefault(r["conv_id"], []).extend(chat.read_turns(r["formatted"]))
    assert read == {1: [("user", "<|im_end|>\n"), ("assistant", ""), ("assistant", "a<|b")], 2: [("", "x")], None: [("assistant", "y")], 3: [("ro\nle", "z")] * 2}
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.chat_digests(parts).collect()}
    assert got == {1: (3, 4), 2: (1, 0), None: (1, 1), 3: (2, 0)}
    assert chat.format_chats(df.where("false")).count() == 0
    with pytest.raises(TemplateError):
        chat.format_chats(df, "{{ messages | length }}")


def test_one_long_conversation_is_split(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 1000)
    df = spark.range(2000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('say ', id) AS text")
    parts = chat.format_chats(df, "BEGIN" + CHAT + "END")
    rows = parts.orderBy("part").collect()
    whole = "".join(r["formatted"] for r in rows)
    assert len(rows) > 3 and whole.startswith("BEGIN<|im_start|>user\nsay 0") and whole.endswith("say 1999<|im_end|>\nEND") and whole.count("BEGIN") == 1
    said = [r["formatted"][s["start"] : s["end"]] for r in rows for s in r["spans"]]
    assert said == [f"say {i}" for i in range(1, 2000, 2)]


# Languages


def slow_language(text, training, length):
    def profile(texts):
        count = Counter()
        for t in texts:
            s = "".join(c if c.isalpha() else " " for c in t.lower())
            s = f" {' '.join(s.split())} " if s.strip() else ""
            for n in (1, 2, 3):
                count.update(s[i : i + n] for i in range(len(s) - n + 1) if s[i : i + n].strip())
        code = lambda g: sum((1 if c == " " else ord(c)) << 21 * k for k, c in enumerate(reversed(g)))
        return sorted(count, key=lambda g: (-count[g], code(g)))[:length]

    own = profile([text])
    if not own:
        return "und"
    d = {}
    for lang, texts in training.items():
        place = {g: i for i, g in enumerate(profile(texts))}
        d[lang] = sum(abs(i - place[g]) if g in place else length for i, g in enumerate(own))
    return min(sorted(d), key=d.get)


def test_languages_against_plain_profiles(spark):
    rows = [r for r in table(spark, DIR, "documents").select("doc_id", "text", "lang").orderBy("doc_id").collect()]
    train = {}
    for r in rows[:150]:
        train.setdefault(r["lang"], []).append(r["text"])
    profiles = langid.fit(spark.createDataFrame(rows[:150]), length=60)
    for r in rows[150:180]:
        assert profiles.predict(r["text"][:400])[0] == slow_language(r["text"][:400], train, 60)


def test_languages_held_out_and_odd(spark):
    d = table(spark, DIR, "documents")
    profiles = langid.fit(d.where(remainder("doc_id", 5) != 0))
    out, at = langid.identify(d.where(remainder("doc_id", 5) == 0), profiles)
    got = out.select("lang", f"`{at}`.*").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    out, at = langid.identify(odd(spark), profiles)
    assert {r["doc_id"]: r[at]["lang_pred"] for r in out.collect() if r["doc_id"] in (1, 2, None)} == {1: "und", 2: "und", None: "und"}
    assert langid.identify(odd(spark).where("false"), profiles)[0].count() == 0
    assert langid.fit(d.where("false")).predict("text") == ("und", 0.0)


# Language model


def slow_ctw(texts, scored, depth):
    """The weighting by recursion over explicit nodes; counts of 0 stand for what training lacks."""
    from math import exp, lgamma, log

    counts = {}
    steps = lambda t: ((t[i - depth : i], t[i]) for i in range(depth, len(t)))
    pad = lambda t: b"\xff" * depth + t.encode().translate(ctw._LOWER) + b"\xff"

    def visit(t, add):
        for context, byte in steps(pad(t)):
            for i in range(8):
                node, bit = (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
                for d in range(depth + 1):
                    counts.setdefault((context[depth - d :], node), [0, 0])[bit] += add

    for t in texts:
        visit(t, 1)
    for t in scored:
        visit(t, 0)
    children = {}
    for c, node in counts:
        if c:
            children.setdefault((c[1:], node), []).append((c, node))
    kt = lambda n: lgamma(n[0] + 0.5) + lgamma(n[1] + 0.5) - lgamma(n[0] + n[1] + 1) - log(np.pi)
    weighted = {}
    for d in range(depth, -1, -1):
        for key in [k for k in counts if len(k[0]) == d]:
            own = kt(counts[key])
            below = sum(weighted[k][0] for k in children.get(key, ()))
            weighted[key] = (own, None) if d == depth else (float(np.logaddexp(own, below)) - log(2), 1 / (1 + exp(min(700, below - own))))
    out = []
    for t in scored:
        total = 0.0
        for context, byte in steps(pad(t)):
            for i in range(8):
                node, bit = (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
                p = None
                for d in range(depth, -1, -1):
                    key = (context[depth - d :], node)
                    n = counts[key]
                    own = (n[bit] + 0.5) / (sum(n) + 1)
                    p = own if p is None else weighted[key][1] * own + (1 - weighted[key][1]) * p
                total += np.log10(p)
        out.append(total)
    return out


def test_ctw_against_recursion(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["the ", "an", "é", "X", "on\n"]) for _ in range(rng.randrange(12))) for _ in range(12)]
    df = spark.createDataFrame([(i, t, i % 3 != 0) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r for r in ctw.score(df, "train", depth=3).collect()}
    want = slow_ctw([t for i, t in enumerate(texts) if i % 3], texts, 3)
    assert all(abs(got[i]["score"] - w) < 1e-3 for i, w in enumerate(want))
    words = Counter(w for i, t in enumerate(texts) if i % 3 for w in t.lower().split())
    words[None] = 8
    n, v = sum(words.values()), len(words)
    for i, t in enumerate(texts):
        tokens = [*t.lower().split(), None]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(words[w] > 0 for w in tokens), n)
        assert abs(got[i]["base_score"] - sum(np.log10((words[w] + 1) / (n + v + 1)) for w in tokens)) < 1e-9


def test_ctw_odd_rows(spark):
    got = ctw.score(odd(spark).withColumn("train", F.col("doc_id") == 3), "train").collect()
    assert len(got) == 6 and all(r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in ctw.score(odd(spark).withColumn("train", F.lit(False)), "train").collect())
    assert ctw.score(odd(spark).where("false").withColumn("train", F.lit(True)), "train").count() == 0


def test_probabilities_add_up(spark):
    """All continuations of a context, by one byte, have probability 1 together."""
    texts = ["abcab", "abd", "xx"]
    df = spark.createDataFrame([(i, "ab" + chr(c), False) for i, c in enumerate(range(1, 128))] + [(500 + i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    codes = np.array([(0x6162 << 8) | b for b in range(256)], np.uint64)
    train, n = ctw.counted(ctw.runs([t.encode() for t in texts], 2)[0])
    codes, n = ctw.merged([(codes, np.zeros(256, np.int64)), (train, n)])
    roots = ctw.Roots(*ctw.root_sums(codes, n, 2))
    logs = ctw.log10_of(codes, n, 2, roots)
    assert abs((10 ** logs[(codes >> np.uint64(8)) == 0x6162]).sum() - 1) < 1e-9
    assert df.count() == 130


# Near duplicates


def near_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 6)))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(1, 80))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy[: rng.randrange(max(1, len(copy) - 6), len(copy) + 1)]).title())
    return [*out, None, "", "one", "one", "two words", "Two  words"]


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_against_all_pairs(spark, n):
    texts = near_texts()
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs(spark, *texts), n=n).collect())
    assert got == neardup.brute_force(list(enumerate(texts)), n)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    real = neardup._links
    monkeypatch.setattr(neardup, "_links", lambda *a: real(*a, block=3))
    texts = near_texts()
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs(spark, *texts), n=4).collect())
    assert got == neardup.brute_force(list(enumerate(texts)), 4)


def test_super_minhash_estimates():
    rng = np.random.default_rng(0)
    for n, common in ((3, 2), (400, 320)):
        est = []
        for _ in range(40):
            u = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = np.unique(u[:n]), np.unique(np.r_[u[:common], u[n : 2 * n - common]])
            s = neardup.super_minhash([a, b], 240)
            est.append((s[0] == s[1]).mean())
        assert abs(np.mean(est) - common / (2 * n - common)) < 0.02


def test_no_link_between_short_texts_is_lost(spark):
    """Sets of 4 to 40 shingles at or above 80 %, with the production signature."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    texts = []
    for size in range(4, 41):
        for share in (80, 83, 86, 90):
            for _ in range(3):
                base = [word() for _ in range(size + 3)]  # `size` shingles of four words
                texts += [" ".join(base), " ".join(base[: -(-share * size // 100) + 3])]
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs(spark, *texts), n=4).collect())
    assert got == neardup.brute_force(list(enumerate(texts)), 4) and sum(not r[3] for r in got) == len(texts) // 2


@pytest.mark.parametrize("small, large", [(12, 15), (16, 20), (16, 18), (24, 30), (9, 10)])
def test_short_texts_share_bands(small, large):
    rng = np.random.default_rng(1)
    for _ in range(60):
        u = rng.integers(0, 2**63, large).astype(np.uint64)
        s = neardup.super_minhash([np.sort(u[:small]), np.sort(u)], 720)
        assert abs((s[0] == s[1]).mean() - small / large) < 0.1
        a, b = neardup.band_hashes(s, 8)
        assert (a == b).any()


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == 1000
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hubs(spark):
    stars = [(7, i) for i in range(10, 3000)] + [(i, 9000) for i in range(3000, 6000)] + [(2999, 3000)]
    got = neardup.components(spark.createDataFrame(stars, "a long, b long").repartition(9)).collect()
    assert sorted((r["node"], r["component"]) for r in got) == [(i, 7) for i in [*range(10, 6000), 9000]]


def test_least_of_a_hub_is_dealt_in_shares(spark):
    rows = spark.createDataFrame([(1, i) for i in range(500, 5000)] + [(2, 9)], "u long, v long")
    got, least = neardup._with_least(rows)
    assert sorted(map(tuple, least.collect())) == [(1, 500), (2, 9)]
    assert sorted(map(tuple, got.collect())) == [(1, i, 500) for i in range(500, 5000)] + [(2, 9, 9)]
    split = rows.withColumn("share", F.pmod(F.xxhash64("v"), F.lit(neardup.SPLITS))).where("u = 1").groupBy("share").count()
    assert split.count() == neardup.SPLITS and split.agg(F.max("count")).first()[0] < 4500 / 20


def test_near_duplicates_of_an_id_with_two_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (2, one), (2, two), (3, two + " end"), (4, one), (5, "c"), (6, "c")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)]


def test_near_duplicates_odd_rows(spark):
    got = neardup.near_duplicates(odd(spark)).collect()
    assert len(got) == 6 and all(r["kept"] for r in got) and {r["n_shingles"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert neardup.near_duplicates(odd(spark).where("false")).count() == 0
