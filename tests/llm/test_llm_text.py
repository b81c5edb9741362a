"""Operators that look at one text at a time: 2, 3, 5, 6, 7."""

import random
import zlib
from array import array

import numpy as np
import pytest
from brute import corpus, documents, prose, quality_base

from bridgelens.llm import html_ctd, packing_mbs, quality_gbt, token_files, token_fst, tokenizing
from bridgelens.session import scratch_path


def test_encoder_matches_the_library_on_whole_texts():
    from tokenizers import Tokenizer

    rng = random.Random(2)
    alphabet = ["a", "B", "of", " ", " ", ", ", ". ", ",", ".", "\n", "\t", "'s", "é", "1", "<|endoftext|>", "!", "\x01", "\x04", "\xa0", "́", "\x1c", "😀", "  ", "_"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [t or "" for _, t in corpus()]
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = tokenizing.tokenizer_path(name)
        want = [array("I", x.ids).tobytes() for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        own = tokenizing.Encoder(path, keeps)
        assert own.encode(texts) == want


def test_encoder_after_any_letter():
    """Letters that normalisation splits into a letter and a mark are no place to cut."""
    from tokenizers import Tokenizer

    letters = [c for c in map(chr, range(0x30000)) if c.isalnum()]
    texts = [f"a{c}, x{c}. b" for c in letters] + [f"{c}, {c}, " for c in letters[::7]]
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = tokenizing.tokenizer_path(name)
        want = [array("I", x.ids).tobytes() for x in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
        got = tokenizing.Encoder(path, keeps).encode(texts)
        assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_encoder_forgets_without_changing_results(monkeypatch):
    texts = [t or "" for _, t in corpus()]
    path = tokenizing.tokenizer_path("byte_bpe_50k.json")
    want = tokenizing.Encoder(path, True).encode(texts)
    monkeypatch.setattr(tokenizing, "CACHE", 50)
    small = tokenizing.Encoder(path, True)
    assert [small.encode([t])[0] for t in texts] == want


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_keeps_what_it_meets_again(monkeypatch, name, keeps):
    """A full memory forgets what was not met lately, not every stretch: a frequent word goes to the library once."""
    monkeypatch.setattr(tokenizing, "CACHE", 50)
    own, sent = tokenizing.Encoder(tokenizing.tokenizer_path(name), keeps), []

    class Spy:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return self.library.encode_batch_fast(texts, **kw)

    own.library = Spy(own.library)
    for k in range(100):
        own.encode([f"the often x{k}"])
        assert len(own.known) + len(own.before) <= 60
    assert len(sent) > 100 and [x.strip() for x in sent].count("often") == 1


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_works_in_bounded_steps_and_memory(monkeypatch, name, keeps):
    """What a call holds follows the step, not the slice; a given memory takes the place of the default."""
    texts = [f"w{k} w{k + 1}, y{k}." for k in range(400)] + ["", "x"]
    want = tokenizing.Encoder(tokenizing.tokenizer_path(name), keeps).encode(texts)
    monkeypatch.setattr(tokenizing, "STEP", 200)
    own, sent = tokenizing.Encoder(tokenizing.tokenizer_path(name), keeps, 50), []

    class Spy:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **kw):
            sent.append(sum(map(len, texts)))
            return self.library.encode_batch_fast(texts, **kw)

    own.library = Spy(own.library)
    assert own.encode(texts) == want and own.encode([]) == []
    assert max(sent) < 400 and len(sent) > 10
    assert len(own.known) + len(own.before) < 250


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_meets_each_stretch_of_a_step_once(name, keeps):
    """What Python does for a step follows its distinct stretches, not its words; texts of all kinds keep their order."""
    from tokenizers import Tokenizer

    texts = ["the often word, the\nend. Often", "", "  the  often", "a\x00b the", "the\xa0often", "\n", "the\tword\r\nend "] * 300
    own, asked = tokenizing.Encoder(tokenizing.tokenizer_path(name), keeps), []

    class Asked(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    own.known = Asked()
    want = [array("I", x.ids).tobytes() for x in Tokenizer.from_file(tokenizing.tokenizer_path(name)).encode_batch_fast(texts, add_special_tokens=False)]
    assert own.encode(texts) == want and own.encode(["", ""]) == [b"", b""]
    assert len(asked) < 100


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_sends_new_stretches_in_runs(name, keeps):
    """Words that were not met yet go to the library many at a time; what may not be joined keeps its ids."""
    from tokenizers import Tokenizer

    rng = random.Random(5)
    odd = ["a\tb", "<|endoftext|>", "x<|endoftext|>y", "don't", "'s", "é", "İx", "x1", "...", "a.%%", "\x00a", "ſ", "a" * 300, "</w>", "Ġa", "\u0301b", "\u200b", "_", "x'S", "\U0001f600"]
    words = ["".join(rng.choice("abcdefghiABE") for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    texts = [" ".join(w for x in words[a : a + 50] for w in ([x, rng.choice(odd) + rng.choice(["", x])] if rng.random() < 0.3 else [x])) for a in range(0, 5000, 50)]
    own, calls = tokenizing.Encoder(tokenizing.tokenizer_path(name), keeps), []

    class Spy:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **kw):
            calls.append(len(texts))
            return self.library.encode_batch_fast(texts, **kw)

    own.library = Spy(own.library)
    want = [array("I", x.ids).tobytes() for x in Tokenizer.from_file(tokenizing.tokenizer_path(name)).encode_batch_fast(texts, add_special_tokens=False)]
    assert own.encode(texts) == want
    assert sum(calls) < len(own.known) / 2


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    rows = corpus()
    folder = scratch_path(spark, "ids")
    manifest = token_files.write_ids(documents(spark, rows), folder, file_text_bytes=20_000)
    assert manifest.select("file").distinct().count() > 2
    found = token_files.read_ids(manifest, folder, with_ids=True).collect()
    library = Tokenizer.from_file(tokenizing.tokenizer_path("byte_bpe_50k.json"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    found.sort(key=lambda r: r["start"])
    start = 0
    for (i, t), r in zip(order, found, strict=True):
        ids = array("I", [*library.encode(t or "", add_special_tokens=False).ids, 0]).tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (i, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    some = token_files.fetch(spark, manifest, folder, [5, 17])
    assert {k: v.tolist() for k, v in some.items()} == {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows if i in (5, 17)}


def test_token_files_notice_damage(spark, tmp_path):
    writer = token_files.Writer(str(tmp_path))
    for k in range(5):
        writer.add(np.arange(100 * k, 100 * k + 50, dtype="<u4").tobytes())
    writer.close()
    reader = token_files.Reader(str(tmp_path), writer.name)
    assert np.frombuffer(next(reader.read(3, 4)), dtype="<u4").tolist() == list(range(300, 350))
    path = tmp_path / writer.name
    raw = bytearray(path.read_bytes())
    raw[int(reader.at[2]) + 20] ^= 0xFF
    path.write_bytes(raw)
    fresh = token_files.Reader(str(tmp_path), writer.name)
    next(fresh.read(1, 2))
    with pytest.raises(Exception):
        next(fresh.read(2, 3))


def test_token_files_of_an_empty_table(spark):
    assert token_files.encode_and_read_back(documents(spark, [])).collect() == []


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = corpus()
    found = packing_mbs.pack_documents(documents(spark, rows), with_ids=True).collect()
    library = Tokenizer.from_file(tokenizing.tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, k * 2048, len(ids[k * 2048 : (k + 1) * 2048]), zlib.crc32(array("I", ids[k * 2048 : (k + 1) * 2048]).tobytes())) for k in range(-(-len(ids) // 2048))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=key) == sorted(want, key=key)
    assert_packed(found, 2048)
    assert len({r["sequence_id"] for r in found}) == -(-sum(r["length"] for r in found) // 2048)


def assert_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_plan_takes_each_piece_once_and_fills_bins(spark):
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.randint(5, 60)
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        plan = packing_mbs.plan(counts, capacity)
        used = {}
        for chosen, times in plan:
            assert sum(x * k for x, k in chosen.items()) <= capacity
            for x, k in chosen.items():
                used[x] = used.get(x, 0) + k * times
        assert used == counts


def test_fullest_against_brute_force():
    from itertools import product

    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.randint(4, 25)
        counts = {rng.randint(1, capacity): rng.randint(1, 3) for _ in range(rng.randint(1, 4))}
        chosen = packing_mbs.fullest(counts, capacity)
        seed = max(counts)
        best = max(s for combo in product(*[range(n + 1) for n in counts.values()]) if (s := sum(x * k for x, k in zip(counts, combo, strict=True))) <= capacity and dict(zip(counts, combo, strict=True))[seed] >= 1)
        assert sum(x * k for x, k in chosen.items()) == best
        assert all(k <= counts[x] for x, k in chosen.items())


def test_packing_numbers_hot_lengths_in_parts(spark):
    rows = [(i, "same words here") for i in range(300)] + [(1000 + i, "other " * (i % 7 + 1)) for i in range(100)]
    pieces = packing_mbs.materialize(packing_mbs.pieces(documents(spark, rows), tokenizing.tokenizer_path("word_bpe_49k.json"), 32), "p")
    found = packing_mbs.pack(pieces, 32, numbered=20).collect()
    assert len(found) == 400 and len({(r["doc_id"], r["piece"]) for r in found}) == 400
    assert_packed(found, 32)
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == 400


def test_packing_of_an_empty_table(spark):
    assert packing_mbs.pack_documents(documents(spark, [])).collect() == []


def test_token_counts(spark):
    import sentencepiece

    rows = corpus()
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizing.tokenizer_path("piece_bpe_32k.model"))
    found = token_fst.token_counts(documents(spark, rows)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows]
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert any(r["over_limit"] for r in found)
    assert token_fst.token_counts(documents(spark, [])).collect() == []


def test_transducer_matches_the_library_in_chunks(monkeypatch):
    import sentencepiece

    path = tokenizing.tokenizer_path("piece_bpe_32k.model")
    model, machine = sentencepiece.SentencePieceProcessor(model_file=path), token_fst.Transducer(path)
    rng = random.Random(1)
    alphabet = " \n▁ \tabcdeéthing of th<s>0x41世界😀ﷺ'.,\x00\xa0"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert {machine.count(text, chunk) for chunk in (1, 5, 7, 1 << 14)} == {len(model.encode(text))}
    for text in ("a" * 5000, " " * 3000, "ab" * 999, "the" * 3000, prose(rng, 3000)):
        assert {machine.count(text, chunk) for chunk in (64, 1 << 14)} == {len(model.encode(text))}
    monkeypatch.setattr(token_fst, "STATES", 10)
    text = prose(rng, 300)
    assert machine.count(text) == len(model.encode(text))


def test_chunk_maps_compose_associatively():
    machine = token_fst.Transducer(tokenizing.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(9)
    for _ in range(300):
        a, b, c = (machine.chunk_map("".join(rng.choice("the ing▁é世 \n") for _ in range(rng.randint(1, 9)))) for _ in range(3))
        left, right = machine.compose(machine.compose(a, b), c), machine.compose(a, machine.compose(b, c))
        assert (left.head, left.count, left.out) == (right.head, right.count, right.out) or left.out is right.out and left.count == right.count


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score string")


def test_quality_statistics(spark):
    rng = random.Random(3)
    line = prose(rng, 12)
    rows = [*corpus(), (900, f"{line}\n{line}\n\n \n{prose(rng, 30)}\n{line}"), (901, " ".join([*"a b c d e f g h".split()] * 2 + [prose(rng, 40)])), (902, "a### b$$ <c> " * 30)]
    found = quality_gbt.quality(documents(spark, rows), labels(spark, [])).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(i, *quality_base(t)) for i, t in rows]
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found), key=key) == sorted(want, key=key)
    assert all(r["kept"] == (not r["base_failed"]) for r in found)  # no labels: no model


def test_repeated_words_against_brute_force():
    rng = random.Random(8)
    for _ in range(100):
        docs = [[rng.choice("abc") for _ in range(rng.randint(0, 60))] for _ in range(4)]
        codes = np.array([ord(w) for d in docs for w in d], dtype=np.int64)
        owner = np.repeat(np.arange(4), [len(d) for d in docs])
        got = quality_gbt.repeated_words(codes, owner)
        want = []
        for d in docs:
            want += [False] * len(d)
        at = 0
        for d in docs:
            n = quality_base(" ".join(d))[4]
            assert got[at : at + len(d)].sum() == n
            at += len(d)


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(5)
    x = rng.random((3000, len(quality_gbt.FEATURES)))
    names = list(quality_gbt.FEATURES)
    symbols, length = names.index("symbols_per_word"), names.index("word_length")
    y = ((x[:, symbols] < 0.5) & (x[:, length] > 0.2)).astype(float)
    forest = quality_gbt.grow(x[:2000], y[:2000])
    assert (((forest.score(x[2000:]) > 0) == (y[2000:] > 0)).mean()) > 0.95
    for k, (_, _, direction) in enumerate(quality_gbt.FEATURES.values()):
        if direction:
            base = np.repeat(x[:200], 21, axis=0)
            base[:, k] = np.tile(np.linspace(0, 1, 21), 200)
            steps = np.diff(forest.score(base).reshape(200, 21), axis=1)
            assert (steps * direction >= -1e-9).all()


def test_quality_verdict_follows_the_labels(spark):
    rng = random.Random(11)
    good = [(i, prose(rng, 60)) for i in range(150)]
    bad = [(1000 + i, " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in prose(rng, 60).split())) for i in range(150)]
    docs = documents(spark, good + bad)
    known = [(i, 1, 0, "a") for i, _ in good[:100]] + [(i, 0, 0, "a") for i, _ in bad[:100]] + [(None, 1, 0, "a"), (77777, 0, 0, "a"), (good[0][0], None, 0, "a")]
    kept = {r["doc_id"] for r in quality_gbt.quality(docs, labels(spark, known)).where("kept").collect()}
    assert kept == {i for i, _ in good}
    stage = quality_gbt.keep_good(docs, labels(spark, known))
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == kept


def test_training_rows_are_bounded(spark):
    """A labelled document that is a third of all rows, labels repeated, and one id with many texts."""
    rng = random.Random(12)
    rows = [(1, "the same text " * 30)] * 300 + [(2, prose(rng, 40)) for _ in range(200)] + [(10 + k, prose(rng, 40)) for k in range(100)]
    known = [(1, 1, 0, "a")] * 50 + [(2, 0, 0, "a"), (2, 0, 0, "b")] + [(10 + k, k % 2, 0, "a") for k in range(50)]
    stats = quality_gbt.document_statistics(documents(spark, rows))
    sample = quality_gbt.label_sample(labels(spark, known))
    assert sample.count() == 52
    found = quality_gbt.training_rows(stats, sample)
    assert 150 < found.count() <= 1 + 200 + 50
    assert quality_gbt.training_rows(stats, sample, 60).count() == 60
    assert quality_gbt.train(stats, sample, 60) is not None


def test_quality_of_an_empty_table(spark):
    assert quality_gbt.quality(documents(spark, []), labels(spark, [])).collect() == []
    assert quality_gbt.keep_good(documents(spark, []), labels(spark, [])).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="</p><article>";</script></head>
<body class="has-sidebar"><nav><ul><li><a href="/a">menu one</a><li><a href='/b'>menu two</a></ul></nav>
<!-- <p>not this</p> --><div class="ad">Buy this now, it is a very long advert text indeed.</div>
<header><h2>Site name</h2></header>
<article><h1>The  title</h1><p><b>First</b> para&shy;graph &lt;here&gt; &#233;&nbsp;x.<br><p>Second one<i>joined</i> text
over lines.<form><input value="a>b">form text</form><aside>side</aside><div class="share-buttons">share</div>
<section id="comments"><p>What a great article, I love it so much.</p></section><ul><li>point<li>other</ul></article>
<div id="sidebar"><p>A sidebar with a paragraph of some length in it.</p></div><footer>&copy; footer</footer></body></html>"""


def test_html_page():
    text = html_ctd.main_text(PAGE)
    assert text == "The title First para\xadgraph <here> é x. Second onejoined text over lines. point other"


def test_html_articles_in_parts():
    def part(name, n, size, tag="p"):
        return [f"{name}{k} " + "x" * size for k in range(n)], "".join(f"<{tag}>{name}{k} {'x' * size}</{tag}>" for k in range(n))

    (a, one), (b, two), (c, three) = part("a", 10, 300), part("b", 10, 200), part("c", 5, 200)
    d, points = part("d", 30, 100, "li")
    menu = '<nav><a href="/">menu</a></nav><div class="ad">buy</div><div><a href="/x">a list of links</a> <a href="/y">and another</a></div><div>short note</div>'
    for holder in ("article", "div"):
        page = f"<body>{menu}<{holder}><section>{one}</section><section>{two}</section></{holder}>{menu}</body>"
        assert html_ctd.main_text(page) == " ".join(a + b)
        page = f"<body>{menu}<{holder}>{three}<ul>{points}</ul></{holder}>{menu}</body>"
        assert html_ctd.main_text(page) == " ".join(c + d)
        page = f"<body>{menu}<{holder}><h1>The title</h1><div>{one}</div></{holder}>{menu}<h2>More to read</h2></body>"
        assert html_ctd.main_text(page) == " ".join(["The title", *a])
    page = f"<body>{menu}<article>{one}</article><article>{two}</article></body>"
    assert html_ctd.main_text(page) == " ".join(a + b)


def article_html(n=6):
    texts = [f"Paragraph {k} of the article with some words in it, and more of them. " * 3 for k in range(n)]
    return "<h1>The title</h1>" + "".join(f"<p>{t}</p>" for t in texts), " ".join(["The title", *(t.strip() for t in texts)])


def test_html_names_alone_do_not_silence_an_article():
    art, want = article_html()
    nav = '<nav><a href="/">menu</a></nav>'
    for page in (
        f'<body><div class="layout has-sidebar">{nav}<div>{art}</div><div class="sidebar"><p>Side text here.</p></div></div></body>',
        f'<body><div class="no-sidebar"><main>{art}</main></div></body>',
        f'<body><article class="post with-comments">{art}</article></body>',
        f'<body><div class="single ad-free">{art}</div></body>',
        f'<body><div class="social-science">{art}</div></body>',
        f'<body><article class="alert-fatigue-study">{art}</article></body>',
        f'<body><form method="post"><input type="hidden" name="v"><div>{art}</div><select><option>x</select></form></body>',
        f'<body><div class="widget">{nav}{art}</div><footer>footer</footer></body>',
        f'<body><div class="search"><article>{art}</article></div></body>',
    ):
        assert html_ctd.main_text(page) == want, page[:80]


def test_html_parts_beside_an_article():
    art, want = article_html()
    much = "".join(f"<p>Reader {k} says that this was a long and good read, thank you very much for it.</p>" for k in range(60))
    for page in (
        f'<body><div class="content">{art}<section id="comments"><h3>Comments</h3>{much}</section></div></body>',
        f'<body><article>{art}</article><div class="comments-area">{much}</div></body>',
        f'<body><article>{art}</article><section class="comment-list"><article class="comment">{much}</article></section></body>',
        f'<body><div class="cookie-banner"><p>We use cookies. Accept them.</p><button>ok</button></div><div class="post-content">{art}</div><aside class="related">{much}</aside></body>',
        f'<body><div id="sidebar-left"><p>Side</p></div><div class="wrapper"><div class="site-header"><h2>Site</h2></div>{art}</div></body>',
        f'<body><article>{art}<div class="newsletter-signup"><p>Sign up for our letter, it is free.</p><form><input></form></div></article></body>',
        f'<body>{art}<div class="more-related"><a href="/1">One more story</a> <a href="/2">and another one</a></div></body>',
        f'<body><form><label>Name</label><input><p>Give us your name here, please, and your mail.</p></form>{art}</body>',
    ):
        assert html_ctd.main_text(page) == want, page[:80]


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.35 or depth > 4:
            out.append(prose(rng, rng.randint(1, 12)))
        else:
            tag = rng.choice(["div", "div", "p", "section", "a", "b", "span", "ul", "li", "h2", "article", "nav", "script"])
            names = rng.choice(["", "", "", ' class="sidebar"', ' class="x ad-slot"', ' id="has-comment"'])
            out.append(f"<{tag}{names}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_html_densities_against_their_definition():
    """Every node's density sum and its plain characters per tag, each counted anew over its whole subtree."""
    import math

    rng = random.Random(21)
    for _ in range(150):
        page = html_ctd.Page(f"<body>{random_page(rng)}</body>")
        n = len(page.tag)
        sums, plain, body = page.densities()
        live = [k for k in range(n) if not page.noise[k]]

        def up(k, page=page):
            while k >= 0:
                yield k
                k = page.parent[k]

        chains = {k: list(up(k)) for k in live}
        inside = {k: [j for j in live if k in chains[j]] for k in live}

        def counts(k, page=page, inside=inside, chains=chains):
            below = chains[k]
            linked = [j for j in inside[k] if any(page.tag[x] == "a" and x not in below[1:] for x in chains[j])]
            return (sum(page.chars[j] for j in inside[k]), len(inside[k]) - 1, sum(page.chars[j] for j in linked), sum(page.tag[j] == "a" for j in inside[k]))

        whole = counts(body)

        def density(c, t, lc, lt, whole=whole):
            if not c:
                return 0.0
            base = math.log(c / max(1, c - lc) * lc + whole[2] / max(1, whole[0]) * c + math.e)
            return c / max(1, t) * max(0.0, math.log(c / max(1, lc) * max(1, t) / max(1, lt))) / max(0.1, math.log(base) if base > 1 else 0.0)

        want = [0.0] * n
        for k in live:
            c, t, lc, _ = counts(k)
            assert abs(plain[k] - (c - lc) / max(1, t)) < 1e-9
            if k and page.tag[k] not in html_ctd.INLINE:
                holder = next(x for x in chains[k][1:] if page.tag[x] not in html_ctd.INLINE)
                want[holder] += density(*counts(k))
        for holder, text in page.blocks:
            if page.tag[holder] not in html_ctd.PARAGRAPHS:
                want[holder] += density(sum(map(len, text.split())), 1, 0, 0)
        assert all(abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip(sums, want, strict=True))


def test_html_reading_is_linear():
    import time

    for page in ("<div>word" * 16000 + "</x>" * 16000, "<center>" * 16000 + "x", "<b>" * 100_000 + "deep", "<div>" * 100_000 + "<p>deep</p>", "<a \"'>" * 60_000, "<p>word" * 50_000, "<i>" + "<table><b>" * 20_000 + "</i>" * 20_000, "<b><div>y" * 30_000, "< " * 100_000, "<html>" * 50_000, "<!--" * 50_000, '<a b="c' * 50_000):
        times = []
        for text in (page[: len(page) // 4], page):
            begin = time.process_time()
            html_ctd.main_text(text)
            times.append(time.process_time() - begin)
        assert times[1] < 16 * times[0] + 0.5 and times[1] < 8, page[:20]


def test_html_odd_pages():
    assert html_ctd.main_text(None) == "" == html_ctd.main_text("") == html_ctd.main_text("<html><body></body>")
    assert html_ctd.main_text("just text &am") == "just text &am"
    assert html_ctd.main_text("<article><p>cut here <b>and</") == "cut here and"
    assert html_ctd.main_text("<article><p>cut here</p><p>and the</arti") == "cut here and the"
    assert html_ctd.main_text("<body><article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    deep = "<div>" * 20000 + "<p>deep text</p>"
    assert html_ctd.main_text(deep) == "deep text"
    assert html_ctd.main_text("<body>" + "<p>word</p>" * 5000) == " ".join(["word"] * 5000)
    assert html_ctd.main_text('<a "' * 2000) == ""


def test_html_query(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", PAGE, "x")]
    found = html_ctd.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = html_ctd.main_text(PAGE)
    assert sorted(((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in found)) == sorted([(1, "u", want, len(want))] * 2 + [(2, "", "", 0), (0, "v", "", 0)])
    assert html_ctd.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
