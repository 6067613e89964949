"""Training-text operators on small cases: edges, brute force, round trips."""

import base64
import random

import numpy as np
import pytest

from quillspan.llm import bytebpe, confusables, langmix, leaks, nearest, sentences, spampages, splitting


def cut(text):
    return [text[a:b] for a, b in sentences.sentence_spans(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Orvane measured 3.5 ms at 9 a.m. on Monday.", "Mr. Keldra left."],
        ["Hestrup & Co. Ltd. shipped 3 crates.", "They came."],
        ["The team of J. R. Kavrosh moved to the U.K. office.", "See fig. 3 and sec. 4.1 there."],
        ["It waited... then it ran.", "Really?", "Yes!"],
        ["He asked, “Who is it?” and left.", "“Stop! Now!” said Prof. Brinsel."],
        ["She wrote: “it works. Nobody noticed.”", "(All is well.)", "The end."],
        ["“The index is old.”", "The next one starts."],
        ["Das gilt z. B. für den Ordner bzw. den Zettel.", "Am 3. Mai 2008 war es so."],
        ["В 2007 г. слой поиска копирует т. е. пишет.", "«Кто там?» — спросила г-жа Orvane.", "Проф. Tessik пишет."],
        ["Voir p. 5, fig. 6,2.", "«\xa0Qui est là\xa0?\xa0» demanda Mme Orvane."],
        ["Open vexdb.toml first.", "vexdb 0.2.6 starts, e.g. the filter."],
        ["9 crates arrived on Feb. 3.", "2 more came."],
        ["¿Quién es?", "«¿Quién copia?», preguntó la Sra. Yorvath."],
    ],
)
def test_sentences_with_blanks(parts):
    assert cut(" ".join(parts)) == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["他问：“谁来描述？”", "存储适配器开始。", "“过期了。”审稿人说。", "真好！"],
        ["待って……始まる。", "「誰が写すの？」と尋ねた。", "Index.binを開く。"],
        ["है।", "क्या है?"],
        ["لماذا؟", "«من؟» سأل المراجع."],
    ],
)
def test_sentences_of_other_scripts(parts):
    joint = "" if any("　" < c < "ꀀ" for c in "".join(parts)) else " "
    assert cut(joint.join(parts)) == parts


def test_thai_blanks_and_lines():
    assert cut("กา ขา\nคา") == ["กา", "ขา", "คา"]
    assert cut("ใช้ LLM เพื่อ 3 ครั้ง") == ["ใช้ LLM เพื่อ 3 ครั้ง"]
    assert cut("# A. B title\r\n- One. Two.\n2. Dr. X. Y\n\n10:00:00 a. b\n  end ") == ["# A. B title", "- One. Two.", "2. Dr. X. Y", "10:00:00 a. b", "end"]
    assert cut("") == cut(None) == cut("  \n ") == []
    assert cut("an unclosed “quote. It goes on. End") == ["an unclosed “quote.", "It goes on.", "End"]


def test_many_unclosed_quotations_change_nothing_after_them():
    line = 'x.‘y. ' * 60 + "He asked, “Who is it?” and left. Then he came."
    assert cut(line)[-2:] == ["He asked, “Who is it?” and left.", "Then he came."]
    assert cut("Look at " + "a-" * 40 + "etc. Then go.") == ["Look at " + "a-" * 40 + "etc.", "Then go."]


def test_very_long_sentences():
    text = "word " * 20_000 + ". " + "(" * 50 + "x"
    spans = sentences.sentence_spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_skeletons():
    s = confusables.skeleton
    same = [("ＡＢＣ１２", "ABC12"), ("ﬁlter", "filter"), ("ꓧꓰꓡꓡꓳ", "HELLO"), ("Ꮯɑt", "Cat"), ("сосна", "coсна"), ("a​b­c", "abc"), ("a b c", "a b c"), ("é", "é"), ("ﾃﾞｰﾀ", "データ"), ("Å", "Å"), ("각", "각"), ("µ", "μ")]
    for a, b in same:
        assert s(a) == s(b), (a, b)
    other = [("A", "a"), ("é", "e"), ("x²", "x2"), ("a.", "a"), ("a b", "b a"), ("ı", "i"), ("l", "1"), ("O", "0"), ("–", "-")]
    for a, b in other:
        assert s(a) != s(b), (a, b)
    assert s(None) is None and s("") == ""
    assert s(s("ﬀö̈ Ѕ")) == s("ﬀö̈ Ѕ")


def test_pieces():
    rng = random.Random(5)
    words = ["alpha", "be", "x" * 30, "Satz.", "字字字。", "é́", "👩🏽‍🔬", "\r\n", "  ", "\n\n"]
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 80)))
        limit, overlap = rng.choice([(20, 5), (40, 0), (60, 59), (7, 2)])
        got = splitting.pieces(text, limit, overlap)
        visible = set(splitting.visible_offsets(text))
        covered = np.zeros(len(text) + 1, bool)
        for a, b in got:
            assert 0 < b - a <= limit
            covered[a:b] = True
            if limit >= 20:
                assert a in visible and b in visible
        assert all(covered[i] or c.isspace() for i, c in enumerate(text))
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))
    assert splitting.pieces("", 5, 1) == splitting.pieces(" \n", 5, 1) == []
    assert splitting.pieces("abcde", 5, 2) == [(0, 5)]
    assert splitting.pieces("abcdefghij", 4, 1) == [(0, 4), (3, 7), (6, 10)]
    assert [("One two. Three four."[a:b]) for a, b in splitting.pieces("One two. Three four.", 12, 0)] == ["One two.", "Three four."]
    assert splitting.Boundaries("ab cde。f").longest_run() == 3


def test_forced_cuts_are_the_gaps_of_the_boundaries():
    rng = random.Random(7)
    stop = splitting.re.compile(r"[\s.!?。！？…।؟]")
    for _ in range(400):
        text = "".join(rng.choice(["ab", "x" * rng.randint(1, 25), ". ", " ", "。", "\n", "é́", "…", "۔"]) for _ in range(rng.randint(0, 40)))
        limit, overlap = rng.choice([(20, 5), (12, 4), (30, 29)])
        got, forced = splitting.cut(text, limit, overlap)
        longest = max(map(len, stop.split(text)))
        assert forced == (len(text) > limit and longest > limit)
        if longest < limit:  # then no piece begins or ends inside a run
            for a, b in got:
                assert b == len(text) or stop.match(text[b - 1]) or stop.match(text[b]) or text[b - 1] in "۔ab"
    # the overlap is given up rather than a run cut
    assert splitting.pieces("aaaa bbbb cccccccccc", 10, 6) == [(0, 9), (10, 20)]


def test_byte_bpe_equals_the_library():
    import tiktoken

    with open(bytebpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("t", pat_str=bytebpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["", None, "Hello, world!  It's 2024.\n\n", "日本語 текст العربية 👩🏽‍🔬", "a" * 3000, "<|endoftext|>", " \t \n", "ก" * 500]
    texts += ["".join(chr(rng.choice([32, 97, 101, 116, 0x4E2D, 0x416, rng.randint(33, 0x2FFF)])) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    got = bytebpe.Encoder(bytebpe.VOCABULARY).batch(texts).to_pylist()
    assert got == [lib.encode_ordinary(t) if t else [] for t in texts]
    assert bytebpe.Encoder(bytebpe.VOCABULARY).batch([]).to_pylist() == []


ITEMS = [
    (1, "en", " ".join(f"word{i}" for i in range(40)), "what is it", "word3 word4"),
    (2, "zh", "".join(chr(0x4E00 + i) for i in range(40)), None, None),
    (3, "en", "too short a passage", None, None),
    (4, "en", " ".join(f"word{i}" for i in range(40)), None, None),
]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (ITEMS[0][2], [1, 4]),
        ("<p>" + ITEMS[0][2].upper().replace(" word1", " <b>word1</b>") + "</p>", [1, 4]),
        ("\n".join(f" {i} | " + " ".join(f"word{j}" for j in range(5 * i, 5 * i + 5)) for i in range(8)), [1, 4]),
        ("x ".join(" ".join(f"word{j}" for j in range(k, k + 8)) + " " for k in (0, 10, 20, 30)), [1, 4]),
        ("x ".join(" ".join(f"word{j}" for j in range(k, k + 7)) + " " for k in (0, 8, 16, 24, 32)), []),
        (" ".join(f"word{i}" for i in range(19)), []),
        (" ".join(f"word{i}" for i in range(20)), [1, 4]),
        (ITEMS[1][2][:20], [2]),
        ("\n".join(ITEMS[1][2][i : i + 9] for i in range(0, 40, 9)), [2]),
        ("。".join(ITEMS[1][2][i : i + 14] + "某" for i in range(0, 40, 15)), []),
        ("what is it word3 word4", []),
        ("", []),
        (None, []),
    ],
)
def test_leaks(text, found):
    assert [i for i, *_ in leaks.Index(ITEMS).leaks(text)] == found


def test_leaks_in_capitals_and_disguise():
    ru = "В опыте Thirustor за 1997 год 19037 читателей из Vobothick сравнили длинный абзац и 39,6 проб на каждое утро недели"
    en = "Nobody at Graskor could say why the very old store adapter forgets the tangled template on every third Monday"
    index = leaks.Index([(1, "ru", ru, None, None), (2, "en", en, None, None)])
    for text, found in [(ru.upper(), [1]), (en.upper(), [2]), (ru.replace("о", "o").replace("В", "B"), [1]), (en.replace("o", "о").replace("N", "Ν"), [2]), (en.replace("adapter", "adap-\n  ter"), [2])]:
        assert [i for i, *_ in index.leaks(text)] == found, text
    (_, share, question, answer), = leaks.Index([(1, "ru", ru, "кто сравнили", "1997")]).leaks(ru.upper())
    assert (share, question, answer) == (1.0, 0.5, 1.0)


def test_leak_candidates_lose_nothing():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, "en", " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 60))), None, None) for i in range(120)]
    index = leaks.Index(items)
    for _ in range(150):
        _, _, passage, *_ = rng.choice(items)
        ws = passage.split()
        a = rng.randint(0, max(0, len(ws) - 8))
        text = " ".join(rng.choice(vocab) for _ in range(20)) + " " + " ".join(ws[a : a + rng.randint(8, 40)])
        tokens = text.split()
        grams = {" ".join(tokens[i : i + 8]) for i in range(len(tokens) - 7)}
        want = []
        for i, _, p, *_ in items:
            t = p.split()
            at = {j for k in range(len(t) - 7) if " ".join(t[k : k + 8]) in grams for j in range(k, k + 8)}
            if len(t) >= 8 and len(at) >= len(t) / 2:
                want.append(i)
        assert [i for i, *_ in index.leaks(text)] == want
    assert leaks.Index([]).leaks("some text") == []


PROSE = "The patient reviewer reads every page before lunch. Nobody else in the office likes the long report, because it rains."


@pytest.mark.parametrize(
    ("text", "spam"),
    [
        (PROSE, False),
        (", ".join(f"{a} tea mill {b}" for a in ("buy", "cheap", "sale", "new") for b in ("top", "online", "price", "shop")), True),
        ("\n".join(f"https://a{i}.example/x/tea-mill?id={i}" for i in range(12)), True),
        ("\n".join(f"- [cheap tea mill {i}](http://x{i}.example/a)" for i in range(12)), True),
        ("\n".join(f"Home > tea mill > {w} tea mill" for w in ("buy", "top", "new", "sale", "free", "best")), True),
        (" ".join(f"#teamill{w} #buyteamill{w}" for w in ("top", "new", "sale", "free", "best", "shop")), True),
        ("\n".join([PROSE] * 6), False),
        (PROSE + "\nSee also:\nhttp://a.example/b", False),
        ("\n".join(f"- {w}" for w in ("a heron", "the old quay", "nine lamps", "wet rope", "an oar")), False),
        (PROSE * 6 + "\n" + ", ".join(["cheap tea mill"] * 8), False),
        ("", False),
        (None, False),
        (" \n", False),
    ],
)
def test_spam_pages(text, spam):
    s = spampages.page_shares(text)
    assert (s is not None and 1 - s["prose"] > spampages.SHARE) == spam
    assert spampages.page_shares("\u200b ...") is None


def test_viterbi_is_the_best_path():
    import itertools

    rng = random.Random(4)
    model = spampages.Model()
    pages = [[rng.randrange(len(spampages.SYMBOLS)) for _ in range(rng.choice([1, 2, 4, 5]))] for _ in range(30)] + [[], [3] * 90]
    paths = model.label_all(pages)
    assert [len(p) for p in paths] == [len(p) for p in pages] and paths[-1] == model.label(pages[-1])
    for obs, path in zip(pages[:30], paths):

        def value(path):
            v = model.start[path[0]] + model.emit[path[0], obs[0]]
            return v + sum(model.move[a, b] + model.emit[b, o] for a, b, o in zip(path, path[1:], obs[1:]))

        assert abs(value(path) - max(value(p) for p in itertools.product(range(4), repeat=len(obs)))) < 1e-9


def test_fitting_raises_the_likelihood():
    rng = np.random.default_rng(2)
    pages = [list(rng.choice(len(spampages.SYMBOLS), 30, p=p)) for p in np.exp(spampages.Model().emit)[[0] * 20 + [2] * 5]]

    def likelihood(m, penalised):
        v = 0.0
        for obs in pages:
            a = m.start + m.emit[:, obs[0]]
            for o in obs[1:]:
                a = np.logaddexp.reduce(a[:, None] + m.move, 0) + m.emit[:, o]
            v += np.logaddexp.reduce(a)
        first = spampages.Model()
        return v + penalised * spampages.PRIOR * sum((np.exp(getattr(first, k)) * getattr(m, k)).sum() for k in ("start", "move", "emit"))

    fitted = spampages.Model().fit(pages)
    assert likelihood(fitted, 1) > likelihood(spampages.Model(), 1)
    for x in (fitted.start, fitted.move, fitted.emit):
        assert np.allclose(np.exp(x).sum(-1), 1)
    assert np.allclose(spampages.Model().fit([]).emit, spampages.Model().emit)


def test_line_breaks_change_nothing_for_spam():
    prose = [f"The {a} keeper carries nine lamps to the {b} before noon." for a, b in zip("red odd old shy wet dry big low new sad".split(), "pier quay mill gate barn dock yard shop lane tower".split())]
    keys = [f"{a} tea mill {b}" for a in ("buy", "cheap", "sale", "new", "top") for b in ("online", "price", "shop", "deals", "free", "best", "review", "outlet")]
    many, one = "\n".join(prose + keys), " ".join(prose + keys)
    for text in (many, one, " ".join(prose) + " " + ", ".join(keys)):
        shares = spampages.page_shares(text)
        assert 1 - shares["prose"] > spampages.SHARE and shares["prose"] > 0.3, text
    for text in ("\n".join(prose), " ".join(prose), " ".join(prose) + " " + " ".join(keys[:8])):
        assert spampages.page_shares(text)["prose"] > 0.5


def test_label_codes():
    assert [langmix.label_code(x) for x in ("EN", "en-GB", "zh-Hans", "deu", "ZHO", "", None, "und", "unknown", "pt_BR", " fr ")] == ["en", "en", "zh", "de", "zh", None, None, None, None, "pt", "fr"]


def test_mixture_keeps_only_languages_that_pay():
    scores = np.array([[0.0, -30, -60], [0, -40, -50], [-3, 0, -50], [-60, -80, 0]])
    mix, post = langmix.fit_mixture(scores, np.ones(4))
    assert mix[1] == 0 and list(post.argmax(1)) == [0, 0, 0, 2] and abs(mix.sum() - 1) < 1e-9


def test_a_language_that_wins_no_sentence_may_be_the_best():
    scores = np.array([[0.0, -40, -2], [0, -40, -2], [-40, 0, -2], [-40, 0, -2]])
    mix, post = langmix.fit_mixture(scores, np.ones(4))
    assert list(post.argmax(1)) == [2, 2, 2, 2] and mix[2] == 1
    # far enough behind it isn't
    mix, post = langmix.fit_mixture(np.where(scores == -2, -30.0, scores), np.ones(4))
    assert list(post.argmax(1)) == [0, 0, 1, 1]


def test_the_chosen_set_is_the_best_of_all_sets():
    import itertools

    rng = np.random.default_rng(8)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        scores = -rng.exponential(12, (n, 5)) * rng.integers(0, 2, (n, 5))
        weights = rng.integers(5, 90, n).astype(float)
        ll = scores * langmix.TEMPER
        ll = ll - ll.max(1, keepdims=True)

        def value(use):
            part = np.exp(ll[:, use])
            pi = np.full(len(use), 1 / len(use))
            for _ in range(langmix.EM_ROUNDS if len(use) > 1 else 0):
                post = part * pi / (part * pi).sum(1, keepdims=True)
                pi = (post * weights[:, None]).sum(0)
                pi = pi / pi.sum()
            return float(np.log((part * pi).sum(1)).sum()) - langmix.PENALTY * len(use)

        sets = [list(s) for k in range(1, 6) for s in itertools.combinations(range(5), k)]
        mix, _ = langmix.fit_mixture(scores, weights)
        assert value(list(np.flatnonzero(mix))) > max(map(value, sets)) - 0.05


def test_words_of_any_length_have_their_own_hash():
    long = "a" * 500
    texts = [f" {long} ", f" {long}b ", f" x {long} ", " a "]
    g = langmix._Grams(texts)
    words = g.hashes[-g.kinds[-1] :].tolist()
    assert len(words) == 5 and words[0] == words[3] and len(set(words)) == 4


def test_scrambled_letters_are_in_no_language():
    import duckdb

    samples = duckdb.connect().execute("SELECT lang, text FROM '/root/testdata/sf0.001/lang_samples.parquet'").fetchall()
    model = langmix.Model(samples, langmix.MIN_KNOWN)
    rng = random.Random(3)
    letters = "".join(c for _, t in samples for c in t.lower() if c.isascii() and c.isalpha())
    junk = ["Tail " + " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(14)) + "." for _ in range(200)]
    assert model.scores(junk)[1].mean() < 0.1
    assert model.scores([t for _, t in samples])[1].all()


def test_scripts_of_one_language_settle_a_sentence():
    model = langmix.Model([("th", "กา ขา คา"), ("ru", "слой поиска"), ("uk", "шар пошуку"), ("en", "a search layer"), ("ja", "検索の層だ"), ("zh", "检索层")])
    assert {k: [model.langs[i] for i in v] for k, v in model.writers.items() if v} == {"": ["en"], "thai": ["th"], "kana": ["ja"], "cyrillic": ["ru", "uk"], "han": ["ja", "zh"]}
    ll, ok = model.scores(["ขา", "слой", "検索の層", "search", "ใช้ search"])
    assert ok.all() and [model.langs[k] for k in ll.argmax(1)] == ["th", "ru", "ja", "en", "th"]


def test_cell_search_against_brute_force():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 64))
    x = np.repeat(centres, 15, 0) + rng.standard_normal((300, 64)) * rng.uniform(0.05, 0.5, (300, 1))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vid = np.arange(300)
    home = np.ones(300, bool)
    home[::7] = False
    a, b, cos = nearest.search_cell(x, vid, home, 5, 0.85)
    got = set(zip(a.tolist(), b.tolist()))
    sim = x @ x.T
    want = set()
    for i in range(300):
        s = np.where(home & (vid != i), sim[i], -2)
        want |= {(i, int(j)) for j in np.argsort(-s)[:5] if s[j] >= 0.85}
    assert len(got & want) / len(want) > 0.97 and len(got - want) < 0.05 * len(want)
    assert np.allclose(cos, sim[a, b], atol=1e-5)
    assert len(nearest.search_cell(x, vid, np.zeros(300, bool), 5, 0.85)[0]) == 0


def test_cell_search_touches_less_than_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((12_000, 64)).astype(np.float32)
    x[6000:] = x[:6000] + 0.3 * rng.standard_normal((6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    touched = []
    real = nearest._collisions
    monkeypatch.setattr(nearest, "_collisions", lambda *a: touched.append(real(*a)) or touched[-1])
    a, b, _ = nearest.search_cell(x, np.arange(12_000), np.ones(12_000, bool), 5, 0.85)
    want = {(i, (i + 6000) % 12_000) for i in range(12_000)}
    assert len(want & set(zip(a.tolist(), b.tolist()))) > 0.99 * len(want)
    assert sum(map(len, touched)) < 0.15 * 12_000**2
    exact = nearest.search_cell(x[::8], np.arange(0, 12_000, 8), np.ones(1500, bool), 5, 0.85, exact=True)
    assert want & set(zip(exact[0].tolist(), exact[1].tolist())) == {p for p in want if p[0] % 8 == 0 and p[1] % 8 == 0}


HOSTILE = ["“a. ", "(", "Dr. ", "<a ", "<a href=x>", "[", "[x](", "<!--", "a=b", "a=b ", "» ", "a.B", "“ « ( \" ", "á", "字。", "1 | a\n"]


@pytest.mark.parametrize("part", HOSTILE)
def test_hostile_long_texts_take_linear_time(part):
    import time

    text = part * 12_000
    t = time.perf_counter()
    spans = sentences.sentence_spans(text)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert all(0 < b - a <= 900 for a, b in splitting.pieces(text, 900, 90))
    spampages.page_shares(text)
    leaks.words(leaks.plain(text))
    langmix.sentences_with_language([text])
    assert time.perf_counter() - t < 10


def test_many_anchors_are_all_searched(monkeypatch):
    rng = np.random.default_rng(6)
    a = rng.standard_normal((905, 32)).astype(np.float32)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    flat, near = nearest.Router(a).nearest(a[:200], 6)
    monkeypatch.setattr(nearest, "FLAT", 50)
    blocks, cos = nearest.Router(a).nearest(a[:200], 6)
    assert (blocks == flat).all() and np.allclose(cos, near, atol=1e-6)



def test_a_long_address_is_no_boundary():
    long = "https://host/" + "a" * 300 + ".Name/" + "b" * 300
    assert cut(f"See {long} first. Then go.") == [f"See {long} first.", "Then go."]
    assert cut("x" * 200 + ".Name=" + "y" * 200) == ["x" * 200 + ".Name=" + "y" * 200]
    assert cut("It was said.Then " + "c" * 100 + "/d it went.") == ["It was said.", "Then " + "c" * 100 + "/d it went."]
    assert cut("x" * 200 + ".Name" + "y" * 100 + "=1 is set.") == ["x" * 200 + ".Name" + "y" * 100 + "=1 is set."]



def test_links_of_any_length():
    card = '<a href="/p/1">' + "<b>blue lamp</b> " * 300 + "</a>"
    assert spampages._links(card) == [(0, len(card))]
    assert spampages.page_shares("\n".join([card] * 8))["links"] > 0.9
    cases = [
        'x <a href="http://u.v/w">one</a> y http://a.b/c z', "<a x>one <a y>two</a> three</a>", "<a <a>b</a>", "[t <a x>](u) v</a> www.x.y", "<A>b</A><a>c</a>", "<a>b", "a</a>", "<ab>c</a>", "[x](y)[z](http://q)",
    ]
    whole = spampages.re.compile(r"<a\b[^<>]*>(?:(?!<a\b).)*?</a>|" + spampages._ADDRESS.pattern, spampages.re.I | spampages.re.S)
    rng = random.Random(3)
    bits = ["<a>", "<a", "</a>", "<A x=1>", " ", "b", "[", "]", "](", ")", "http://h", "www.k", "<b>", "\""]
    cases += ["".join(rng.choices(bits, k=12)) for _ in range(3000)]
    for t in cases:
        assert spampages._links(t) == [m.span() for m in whole.finditer(t)], t
