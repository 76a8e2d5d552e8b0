"""Small fixtures with nulls, empty and repeated texts, empty tables and clashing columns, against brute force."""

import hashlib
import re
import zlib

import pytest

from gridweave.llm import chat, webtext
from gridweave.llm.exact import exact_duplicates, rice_decode, rice_encode
from gridweave.llm.lines import line_dedup, without_repeated_chunks, without_repeated_runs
from gridweave.llm.lm import lm_scores
from gridweave.llm.neardup import near_duplicates
from gridweave.llm.packing import pack
from gridweave.llm.queries import ship, tokenizer_file
from gridweave.llm.toxicity import toxicity
from gridweave.llm.urls import url_filter

DOCS = "doc_id long, text string, id string, row int"


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, f"the word{i % 7} of page {i % 5} is here\nline {i % 3}\nlast {i % 2} " + "common words " * (i % 4), "x", 1) for i in range(40)]
    rows += [(50, None, None, None), (51, "", "", 2), (52, "   \n ", "a", 3), (None, "stray", "b", 4), (53, "long " * 30000, "c", 5), (1, rows[1][1], "x", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_rice_codes():
    import numpy as np

    v = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 500, dtype=np.uint64))
    assert (rice_decode(rice_encode(v)) == v).all()


def test_exact(spark, docs):
    got = exact_duplicates(docs).collect()
    rows = docs.collect()
    by = {}
    for r in rows:
        by.setdefault(r.text or "", []).append(r.doc_id)
    assert len(got) == len(rows)
    for g in got:
        assert any(hashlib.sha256(t.encode()).hexdigest() == g.text_sha256 and g.group_size == len(i) for t, i in by.items())
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_near(spark, docs):
    got = {r.doc_id: r for r in near_duplicates(docs, shingle_words=2).collect()}

    def sh(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w)} if 0 < len(w) < 2 else set(zip(w, w[1:], strict=False))

    sets = {r.doc_id: sh(r.text) for r in docs.collect() if r.doc_id is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: got[i].component_id for i in sets} == root
    assert all(got[i].n_shingles == len(s) for i, s in sets.items())
    assert near_duplicates(docs.limit(0)).count() == 0


def test_lines(spark, docs):
    got = line_dedup(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[50].text is None and by[50].n_lines == 0 and by[51].text == "" and by[51].n_lines == 1
    kept = without_repeated_chunks(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 50, 51, 53}


def test_repeated_runs_in_foreign_surroundings(spark):
    """Planted passages of 1, 2, 3 and 5 lines go from all copies but the first, and nothing else goes."""
    own = iter(range(10**6))
    alone = lambda n: [f"own line {next(own)}" for _ in range(n)]
    plant = {k: [f"passage {k} line {j} " + " ".join(f"w{k}x{j}y{t}" for t in range(60 if k == 1 else 12)) for j in range(k)] for k in (1, 2, 3, 5)}
    want, rows = {}, []
    for i in range(48):
        k, before, after = (1, 2, 3, 5)[i % 4], alone(1 + i % 6), alone(1 + i // 4 % 5)
        rows.append((i, "\n".join(before + plant[k] + after)))
        want[i] = "\n".join(before + (plant[k] if i < 4 else []) + after)
    rows += [(100, "short"), (101, "x\n\n\ny"), (102, "z\n\n\nt\nshort\nq"), (103, None), (104, "r\nr\nr\nr"), (105, "\n".join(plant[1]))]
    want |= {100: "short", 101: "x\n\n\ny", 102: "z\n\n\nt\nshort\nq", 103: None, 104: "r"}
    got = without_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_pipeline_removes_repeated_runs(spark):
    import corpus_pipeline

    p = " ".join(f"word{i}" for i in range(60))
    d = spark.createDataFrame([(1, f"a\n{p}\nb", 1), (2, f"c\n{p}\nd", 1)], "doc_id long, text string, n_chars int")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, d, "").collect()} == {1: f"a\n{p}\nb", 2: "c\nd"}


def test_pack(spark, docs):
    got = pack(docs, tokenizer_file()).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 4096).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]]
    for (_, n), s in got[got.doc_id == 53].groupby(["doc_id", "doc_tokens"]):
        assert s.length.sum() == n
    assert pack(docs.limit(0), tokenizer_file()).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "<|end|>\n<|turn|>", "<<SYS>>", "plain", None, ""]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(None, 0, None, "x")]
    t = chat.turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    f = chat.format_chats(t)
    got = {r.conv_id: r for r in chat.digests(f).collect()}
    want = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in rows[:-1])
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].n_turns == len(texts)
    assert got[1].loss_sha256 == hashlib.sha256("".join(r[3] or "" for r in rows[:-1] if r[2] == "assistant").encode()).hexdigest()
    assert "</s>" not in f.where("conv_id = 1").first().formatted and chat.format_chats(t.limit(0)).count() == 0


def test_layouts(spark):
    rows = [(1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'), (2, '{"prompt":"a","completion":"b"}'), (3, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'), (4, "not json"), (5, None)]
    got = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, rec string"), "conv_id", "rec").orderBy("conv_id", "pos").collect()
    assert [(r.role, r.text) for r in got[:6]] == [("user", "a"), ("assistant", "b")] * 3 and [r.layout for r in got[6:]] == [None, None]


def test_every_layout_has_its_mapping(spark):
    recs = {
        "turn": ('{"role":"human","text":"a"}', [("user", "a")]),
        "messages": ('{"messages":[{"role":"user","content":"a"},{"role":"bot","content":"b"}]}', [("user", "a"), ("assistant", "b")]),
        "conversations": ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', [("user", "a"), ("assistant", "b")]),
        "prompt": ('{"prompt":"a","completion":"b"}', [("user", "a"), ("assistant", "b")]),
        "instruction": ('{"output":"b","instruction":"a"}', [("user", "a"), ("assistant", "b")]),
        "instruction_input": ('{"instruction":"a","input":"i","output":"b"}', [("user", "a"), ("user", "i"), ("assistant", "b")]),
        "system_prompt": ('{"system":"s","prompt":"a","completion":"b"}', [("system", "s"), ("user", "a"), ("assistant", "b")]),
        "question": ('{"question":"a","answer":"b"}', [("user", "a"), ("assistant", "b")]),
        "nested": ('{"data":{"prompt":"a","response":"b"}}', [("user", "a"), ("assistant", "b")]),
    }
    assert set(recs) == {m.name for m in chat.MAPPINGS}
    got = {}
    for r in chat.canonical_turns(spark.createDataFrame([(k, v[0]) for k, v in recs.items()], "conv_id string, rec string"), "conv_id", "rec").orderBy("pos").collect():
        got.setdefault((r.conv_id, r.layout), []).append((r.role, r.text))
    assert got == {(k, k): v[1] for k, v in recs.items()}


def test_web(spark):
    ship(spark)
    foot = "all rights are kept by the owner of this site here"
    page = lambda x: f"<body><div><p>{x}</p><p>{foot}</p></div></body>"
    rows = [(1, "http://h.example/1", page("one &amp; only")), (2, "http://h.example/2", page("two")), (3, "http://o.example/3", page("three")), (4, None, None),
            (5, "http://h.example/5", f"<nav>m</nav><article><h1>T</h1><p>a  b<br>c<div class='ad'>x</div><p>{foot}</article><footer>f</footer>")]
    got = {r.page_id: r.text for r in webtext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "one & only", 2: "two", 3: f"three\n{foot}", 4: "", 5: f"T\na b\nc\n{foot}"}


def test_web_keeps_copies_and_shared_passages(spark):
    ship(spark)
    foot, quote = "all rights are kept by the owner of this site here", "a passage of ten words that two pages share whole"
    page = lambda *x: "<body>" + "".join(f"<p>{t}</p>" for t in (*x, foot)) + "</body>"
    text = "the main text of a page that was captured two times"
    rows = [(1, "http://c.example/1", page(text)), (2, "http://c.example/2", page(text)), (3, None, page(text)), (4, None, page(text))]
    rows += [(10 + i, f"http://q.example/{i}", page(f"page {i}", *[quote] * (i < 2))) for i in range(5)] + [(20, "http://q.example/0b", page("page 0", quote))]
    got = {r.page_id: r.text for r in webtext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"{text}\n{foot}" for i in (1, 2, 3, 4)} | {10 + i: f"page {i}" + f"\n{quote}" * (i < 2) for i in range(5)}
    assert got == want | {20: f"page 0\n{quote}"}


def test_web_learns_boilerplate_from_pages_with_an_article(spark):
    ship(spark)
    foot = "all rights are kept by the owner of this site here"
    rows = [(i, f"http://a.example/{i}", f"<body><article><p>article {i}</p></article><div>{foot}</div></body>") for i in range(3)]
    rows += [(3, "http://a.example/3", f"<body><p>bare</p><div>{foot}</div></body>"), (4, "http://b.example/4", f"<body><p>bare</p><div>{foot}</div></body>")]
    got = {r.page_id: r.text for r in webtext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "article 0", 1: "article 1", 2: "article 2", 3: "bare", 4: f"bare\n{foot}"}


def test_urls(spark):
    e = spark.sql("SELECT * FROM VALUES ('s', 'bad.example', 'add', timestamp'2024-01-10'), ('s', 'bad.example', 'remove', timestamp'2024-02-10'), ('s', 'ok.example/x', 'add', timestamp'2024-01-01'), ('s', null, 'add', null) AS e(list, key, action, at)")
    c = spark.sql("SELECT * FROM VALUES (1, 'http://a.bad.example/q', timestamp'2024-01-09'), (2, 'http://a.bad.example:80/q', timestamp'2024-01-10'), (3, 'http://bad.example', timestamp'2024-02-10'), (4, 'http://ok.example/x/y?z', timestamp'2024-03-01'), (5, 'http://ok.example/xy', timestamp'2024-03-01'), (6, null, timestamp'2024-03-01'), (7, 'nothing', null) AS c(page_id, url, fetched_at)")
    assert {r.page_id for r in url_filter(c, e).collect() if r.blocked} == {2, 4} and url_filter(c, e).count() == 7 and url_filter(c, e.limit(0)).where("blocked").count() == 0


def test_lm(spark, docs):
    import math
    from collections import Counter

    got = lm_scores(docs).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]
    rows = docs.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for r in rows if not held(r.doc_id) for w in words(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted(round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(r.text)), 4) for r in rows)
    assert sorted(round(r.base_score, 4) for r in got) == want and all(r.train_tokens == n and r.score < 0 for r in got)
    assert lm_scores(docs.limit(0)).count() == 0


def test_lm_holds_the_count_of_the_end(spark):
    import math

    d = spark.createDataFrame([(2, " ".join(f"w{i}" for i in range(300)) + " " + " ".join(f"w{i}" for i in range(300)))], "doc_id long, text string")
    assert zlib.crc32(b"2") % 5 != 1
    got = lm_scores(d, top=1).first()
    assert got.n_known == got.n_tokens == 601
    assert got.base_score == pytest.approx(600 * math.log10(2.5 / 752) + math.log10(1.5 / 752))


def test_lm_gives_every_frequent_word_its_own_vectors():
    """Words beyond the first 255 are predicted from their context, and all words' probabilities sum to one."""
    import numpy as np

    from gridweave.llm import lm

    names = [f"w{i}" for i in range(900)]
    pairs = [f"{names[600 + i % 300]} {names[300 + i % 300]}" for i in range(3000)]
    col = lambda x: lm.pa.array(x, lm.pa.string())
    h, cls, row = lm.tokens(*lm.text_bytes(col(pairs + names[:300] * 20)))
    u, at, c = np.unique(h, return_index=True, return_counts=True)
    order = np.argsort(-c, kind="stable")
    first = [i for i in order if u[i] != lm.END][: lm.WORDS]
    left = np.setdiff1d(order, [*first, np.searchsorted(u, lm.END)])
    classes = {k: (int(c[left][cls[at[left]] == k].sum()), int((cls[at[left]] == k).sum())) for k in range(lm.CLASSES)}
    vocab = lm.Vocabulary([(int(u[i].view(np.int64)), int(c[i])) for i in order], int(c.sum()), len(u), classes, [int(cls[at[i]]) for i in order], 10)
    ids, member, _, own = vocab.look(h, cls)
    assert vocab.members == 900 - lm.WORDS + lm.CLASSES and ((member >= 0) == ~own).all()
    m, rng = lm.start_model(vocab), np.random.default_rng(1)
    acc = {k: np.full(x.shape, 1e-6) for k, x in m.items()}
    before = lm.log_probs(m, vocab, ids, member, row)
    for _ in range(60):
        lm.train(m, acc, vocab, ids, member, row, rng)
    after = lm.log_probs(m, vocab, ids, member, row)
    second = np.flatnonzero(~own & (np.concatenate(([-1], row[:-1])) == row))
    assert after[second].mean() > before[second].mean() + 0.5
    # every possible next token after one word: classes with their own output, and the members of the others
    nxt = [(i, -1) for i in range(vocab.size - lm.CLASSES)] + [(1 + lm.WORDS + k, j) for k in range(lm.CLASSES) for j in range(vocab.start[k], vocab.start[k + 1])]
    i2, m2 = (np.array([(a, b) for p in nxt for a, b in ((ids[0], p[0]), (member[0], p[1]))][x::2]).ravel() for x in (0, 1))
    lp = lm.log_probs(m, vocab, i2, m2, np.repeat(np.arange(len(nxt)), 2))[1::2]
    assert (10**lp).sum() == pytest.approx(1, abs=1e-4)


def test_toxicity(spark, docs):
    ship(spark)
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))  # noqa: E731  copies would count once
    rows = [(i, f"some text {name(i)} " + ("you idiot" if i % 4 == 0 else "thank you")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity(d, lab).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got)
    flat = toxicity(docs, lab.limit(0)).collect()
    assert len({r.score for r in flat}) == 1 and len(flat) == docs.count()
