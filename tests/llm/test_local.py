"""The numpy and Python parts of the operators, without Spark, against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from redline.llm import features, html_render, kneser_ney, phrase_automata, quality_model, repetition, token_output, toxicity
from redline.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c a b c", "Línea é\nLínea é\n\nLínea é", "x" * 5000, "tab\tand\x0bvt\x0cff\rcr",
    "no break stays one", "# * $ words & more | <b>", "\n".join(["same line here"] * 30), "end \n",
]


def random_texts(n: int, seed: int = 3) -> list[str]:
    draw = random.Random(seed)
    vocab = ["the", "of", "Ab", "é", "zz!", "10", "and", "x-y"]
    return [draw.choice(["", " "]) + "".join(draw.choice(vocab) + draw.choice([" ", " ", "  ", "\n"]) for _ in range(draw.randrange(60))) for _ in range(n)]


def test_words_are_cut_as_the_pattern_says():
    texts = TEXTS + random_texts(50)
    for limit in (1, 40, 1 << 20):
        got = []
        for _, _, data, offsets in W.text_chunks(pa.array(texts, pa.string()), limit):
            starts, ends, bounds = W.word_spans(data, offsets)
            cut = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
            got += [cut[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [WORD.findall(t or "") for t in texts]


def test_hashes_follow_the_words_only():
    def hashes(text, n):
        (_, _, data, offsets), = W.text_chunks(pa.array([text]))
        starts, ends, _ = W.word_spans(data, offsets)
        return W.ngram_hashes(W.span_hashes(data, starts, ends), n).tolist()

    assert hashes("a bc d", 2) == hashes("  a \n bc\td", 2)
    assert len(set(hashes("a bc d ab c d cd ba", 1))) == 7
    assert hashes("a b", 2) != hashes("b a", 2)


def plain_repetition(text: str) -> dict:
    words = WORD.findall(text or "")

    def covered(n):
        seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return {j for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}

    lines, seen, dup, dup_chars = (text or "").split("\n"), set(), 0, 0
    for line in lines:
        if WORD.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup}
    out |= {"dup_line_chars": dup_chars, "n_repeat_words": len(covered(3))}
    kept = dup_chars <= repetition.LINE_LIMIT * out["word_chars"]
    for n, limit in repetition.NGRAM_LIMITS.items():
        chars = sum(len(words[j]) for j in covered(n))
        out[f"dup_{n}gram_chars"] = chars
        kept &= chars <= limit * out["word_chars"]
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    out["kept"] = kept and not out["base_failed"]
    return out


def test_repetition_against_plain_counts():
    texts = TEXTS + random_texts(80)
    got = [repetition.measure(d, o, repetition.NGRAM_LIMITS, repetition.LINE_LIMIT) for _, _, d, o in W.text_chunks(pa.array(texts), 500)]
    joined = {k: np.concatenate([g[k] for g in got]).tolist() for k in got[0]}
    want = [plain_repetition(t) for t in texts]
    for name, values in joined.items():
        assert values == [w[name] for w in want], name


def test_features_count_runs():
    text, place, count = features.hashed(*next(W.text_chunks(pa.array(["go go!! stop", "", "go"])))[2:], 18, 1, False)
    assert text.tolist() == [0, 0, 0, 2] and sorted(count[:3].tolist()) == [1, 1, 2]
    assert place[text == 2][0] in place[text == 0]


@pytest.mark.parametrize("largest", [1, 255, 50_000, 2**20, 2**40, 2**64 - 1])
def test_simple8b_round_trip(largest):
    draw = random.Random(largest)
    for n in (0, 1, 59, 127, 128, 129, 1000, 5000):
        ids = np.array([draw.choice([0, 1, draw.randrange(largest + 1), draw.randrange(min(largest, 300) + 1)]) for _ in range(n)], np.uint64)
        words, offsets = token_output.pack(ids)
        assert (token_output.unpack(words, offsets, n) == ids).all()
        assert offsets[-1] == len(words) and len(offsets) == -(-n // token_output.BLOCK_IDS) + 1
        for b in range(len(offsets) - 1):  # each block alone
            first, size = b * token_output.BLOCK_IDS, min(token_output.BLOCK_IDS, n - b * token_output.BLOCK_IDS)
            own = words[offsets[b] : offsets[b + 1]]
            assert (token_output.unpack(own, np.array([0, len(own)], np.uint32), size) == ids[first : first + size]).all()


def test_small_ids_pack_densely():
    assert len(token_output.pack(np.ones(6000, np.uint64))[0]) <= 6000 // 128 * 3 + 3


def test_pieces_give_the_ids_of_whole_texts():
    public = pytest.importorskip("public_tokenizers")
    encoder = token_output.PieceEncoder(public.path("byte_bpe_50k.json"))
    texts = [t or "" for t in TEXTS] + random_texts(60) + [
        "it's they're I'll don't 'quoted' (a,b) x--y", "&&& a*** b%%% c### <|endoftext|> d", "a  b", "a\n\nb", " lead", "tail ", "a \nb",
        "é  x", "日本語 text — dash…", "12ab ab12 1,000.5", "don''t ''s x' y'' A!? B?!.", "  line sep", "x\u0085y z",
    ]
    assert encoder.encode(texts) == [encoder.whole(t) if t else b"" for t in texts]


def test_ids_are_those_of_the_plain_library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["one doc<|endoftext|>next doc", "<|endoftext|>", "a <|endoftext|> b\nc<|endoftext|>", "x  <|endoftext|><|endoftext|>", "<|endoftext |> <|endof text|>"] + [t for t in TEXTS if t] + [t for t in random_texts(40) if t]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_output.PieceEncoder(path).encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [505, 2205, 50256, 19545, 2205]


HTML = {
    "<p>a<p>b <b>c</b>\n d": "a\n\nb c d",
    "<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>tail": "- x\n- y\n  3. q\n  4. r\n\ntail",
    "<table><tr><th>Name<th>N<tr><td>long name<td>7</table>end": "Name      | N\nlong name | 7\n\nend",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a | b\n  | c",
    "<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>": "wide |   | x\na    | b | c",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<pre> k\n  l</pre>": " k\n  l",
    "<div hidden>no</div><span style='color:red; display : none'>no</span>yes": "yes",
    "<details><summary>S</summary>no</details><dialog>no</dialog><input type=hidden value=no>": "S",
    "<head><title>t</title></head><script>var a='</p>';</script><style>p{}</style>text": "text",
    "x &amp; &lt;y&gt; &eacute;&nbsp;z": "x & <y> é z",
    "one<div>two</div>three": "one\ntwo\nthree",
    "cut off <a href='": "cut off",
    "<blockquote>q</blockquote>after": "  q\n\nafter",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n  d\nu",
    "": "", "<p></p>": "", "<!-- c -->": "",
}


@pytest.mark.parametrize("html", list(HTML))
def test_page_text(html):
    assert html_render.page_text(html) == HTML[html]


def test_deep_and_null_pages():
    assert html_render.page_text(None) == ""
    assert html_render.page_text("<div>" * 3000 + "deep" + "</div>" * 3000 + "on") == "deep\non"
    assert html_render.page_text("<ul><li>" * 1000 + "x").endswith("- x")


def test_every_visible_word_comes_out_once():
    draw = random.Random(4)
    tags = ["p", "div", "li", "ul", "b", "td", "tr", "table", "h2", "span", "pre", "blockquote"]
    for _ in range(200):
        html, words = "", []
        for i in range(draw.randrange(1, 30)):
            tag = draw.choice(tags)
            html += draw.choice([f"<{tag}>", f"</{tag}>", f"<{tag}>"]) + f" w{i} "
            words.append(f"w{i}")
        assert sorted(re.findall(r"w\d+", html_render.page_text(html))) == sorted(words)


def test_logistic_learns_and_degenerates():
    one, two = (np.array([1, 2]), np.array([0.7, 0.7])), (np.array([2, 3]), np.array([0.7, 0.7]))
    w, b = quality_model.fit_sample([(*one, 1), (*two, 0)] * 60, 4, 5)
    assert w[one[0]] @ one[1] + b > 0 > w[two[0]] @ two[1] + b
    w, b = quality_model.fit_sample([(*one, 1)] * 3, 4, 2)
    assert not w.any() and b > 0
    assert quality_model.fit_sample([], 4, 2)[1] == 0


def test_ordinal_model_orders_severity():
    clean, mild, strong = np.array([1]), np.array([1, 2]), np.array([1, 2, 3, 4])
    model = toxicity.OrdinalModel(8, 3)
    for _ in range(150):
        for row, y in ((clean, 0), (mild, 1), (strong, 2)):
            model.step(row, y)
    w = np.maximum(model.weights.weights()[:8], 0)
    severity = toxicity.probabilities(np.array([w[r].sum() for r in (clean, mild, strong)]), model.cut).sum(1)
    assert severity[0] < 0.5 < severity[1] < 1.5 < severity[2]
    assert (np.diff(model.cut) > 0).all()


def test_discounts_and_floor_sum_to_one():
    total = {"tokens": 9, "vocabulary": 3, "kinds": 5, "k1": 2, "k2": 0, "k3": 1, "k4": 0, "k_more": 1, "c1": 4, "c2": 1, "c3": 1, "c4": 0}
    p_word = kneser_ney.word_probability(np.array([1, 1, 3, 0]), total)
    assert p_word.sum() == pytest.approx(1)
    context = {k: np.full(4, v) for k, v in {"count": 6, "n1": 1, "n2": 1, "n3": 1}.items()}
    assert kneser_ney.probability(np.array([1, 2, 3, 0]), context, p_word, total).sum() == pytest.approx(1)
    assert kneser_ney.word_probability(np.zeros(1, int), {"vocabulary": 0, "kinds": 0})[0] == 1


def test_one_block_drops_what_came_before():
    a, b = " ".join(f"w{i}" for i in range(20)), " ".join(f"v{i}" for i in range(13))
    table = pa.table({"doc_id": pa.array([5, 2, 9, 9, None]), "text": pa.array([a, f"x {a} y", b, b, f"{b} z"])})
    got = phrase_automata.strip_repeats(phrase_automata.BlockWords(table, 13, 8), [])
    assert list(zip(got["doc_id"].to_pylist(), got["n_removed"].to_pylist())) == [(2, 0), (5, 20), (9, 0), (9, 0), (None, 13)]
    assert got["kept_text"].to_pylist()[-1] == "z"
