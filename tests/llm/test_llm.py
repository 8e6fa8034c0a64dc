"""Operators of the subpackage against brute force, and their edge cases."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import leakage, mixing, neardup, packing, pairs, queries, residue, truncation
from millrace.llm import tokens as T
from tests.test_oracle import rows

WORDS = [f"w{i}" for i in range(4_000)]


def text_of(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, name):
    """Every query of the subpackage that has SQL gives the same rows in DuckDB."""
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(c.execute(queries.SQL[name]).df())


# ---- tokens


def test_word_hashes_match_words():
    texts = ["", None, "Ａbc １２ x_y", "沈静 is 好的", "a" * 5_000, "ﬁne É é", "🙂 ok", "\x00\n\t"]
    h, o = T.word_hashes(texts)
    seen = {}
    for i, t in enumerate(texts):
        w = T.words(t)
        assert len(w) == o[i + 1] - o[i]
        for x, y in zip(w, h[o[i] : o[i + 1]].tolist()):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)
    s, so = T.shingle_hashes(h, o, 3)
    assert np.diff(so).tolist() == [max(0, len(T.words(t)) - 2) for t in texts] and len(s) == so[-1]


# ---- 1, 5


@pytest.mark.parametrize(
    ("prompt", "text", "want"),
    [
        ("p", None, ["empty"]), ("p", " ​\n", ["empty"]), ("p", "<answer> </answer>", ["empty"]), ("p", "N/A", ["empty"]), ("p", "\\boxed{}", ["empty"]), ("p", "<think>\n\n</think>", ["empty"]),
        ("How many of the apples are in the box?", "B", []), ("How many of the apples are in the box?", "42", []), ("x of the y", "x = 5", []), (None, "fine words", []),
        ("How many of the apples are in the box?", "I'm sorry, but I cannot help with this request.", ["refusal"]), ("Wie viele Äpfel sind in der Kiste?", "Leider kann ich dabei nicht helfen.", ["refusal"]),
        ("How many of the apples are in the box?", "抱歉，我无法帮助解决这个问题。", ["refusal"]), ("How many of the apples are in the box?", "I cannot simply divide here, so the answer is 4.", []),
        ("How many of the red apples are in the big box?", "HOW MANY OF THE RED APPLES ARE IN THE BIG BOX?", ["copy"]), ("How many of the red apples are in the big box?", "How many of the red apples are in the big box? #### 4", []),
        ("How many of the red apples are in the big box?", "Es gibt in der Kiste nicht mehr als vier Äpfel.", ["language"]), ("How many of the red apples are in the big box? Answer in German.", "Es gibt in der Kiste nicht mehr als vier Äpfel.", []),
    ],
)
def test_pair_rules(prompt, text, want):
    assert pairs.rules(prompt, text) == want


#: Pairs in words that the tables do not use: for every language a prompt, sound answers, refusals, and answers in another language.
UNSEEN = {
    "en": (
        "Which of the two roads that leave the village is the shorter one, and why do most of the carters take the other?",
        ["The northern road is shorter, but it climbs over the ridge and carts with a heavy load do not get up there in winter.", "They take the lower road since the upper one is washed out each spring.", "Both are of the same length; the carters like the inn at the lower road.", "The one by the mill. Its bridge is too weak for a cart, so the carters go round."],
        ["I'm sorry, but I'm not able to answer this question.", "I must decline to answer that request.", "As a language model I cannot help with your question. You may want to ask somebody who lives there.", "Unfortunately I am not allowed to respond to requests like this.", "I won't assist with this task."],
    ),
    "de": (
        "Welche der beiden Straßen aus dem Dorf ist die kürzere, und warum nehmen die meisten Fuhrleute die andere?",
        ["Die nördliche Straße ist kürzer, aber sie führt über den Kamm und ist im Winter nicht zu befahren.", "Sie nehmen die untere, weil die obere jedes Frühjahr unter Wasser steht.", "Beide sind gleich lang, und an der unteren liegt das Gasthaus.", "Die an der Mühle ist kürzer. Ihre Brücke ist für einen Wagen zu schwach."],
        ["Es tut mir leid, aber ich kann diese Frage nicht beantworten.", "Bei dieser Aufgabe darf ich leider nicht helfen.", "Ich muss diese Anfrage ablehnen.", "Leider ist es mir nicht möglich, die Frage zu beantworten.", "Als Assistent möchte ich dazu nichts sagen und kann dabei nicht helfen."],
    ),
    "fr": (
        "Laquelle des deux routes qui partent du village est la plus courte, et pourquoi les charretiers prennent-ils l'autre ?",
        ["La route du nord est plus courte, mais elle passe par la crête et les charrettes ne la montent pas en hiver.", "Ils prennent celle du bas parce que celle du haut est coupée chaque printemps.", "Les deux ont la même longueur, et il y a une auberge sur celle du bas.", "Celle du moulin est la plus courte. Son pont est trop faible pour une charrette."],
        ["Je suis désolé, mais je ne peux pas répondre à cette question.", "Je dois refuser cette demande.", "Malheureusement, je ne suis pas en mesure de vous aider.", "Il m'est impossible de traiter cette demande.", "Je préfère ne pas répondre à cette question."],
    ),
    "es": (
        "¿Cuál de los dos caminos que salen del pueblo es el más corto, y por qué los carreteros toman el otro?",
        ["El camino del norte es más corto, pero sube por la cresta y los carros no lo pasan en invierno.", "Toman el de abajo porque el de arriba se inunda cada primavera.", "Los dos tienen la misma longitud, y en el de abajo hay una posada.", "El del molino es el más corto. Su puente es demasiado débil para un carro."],
        ["Lo siento, pero no puedo responder a esta pregunta.", "Debo rechazar esta solicitud.", "Lamentablemente no me es posible ayudar con eso.", "No estoy autorizado a responder a esta pregunta.", "Prefiero no contestar a esta pregunta."],
    ),
    "zh": (
        "离开村子的两条路哪一条更短，为什么大多数车夫走另一条？",
        ["北边的路更短，但是要翻过山脊，冬天车子上不去。", "他们走下面那条，因为上面那条每年春天都会被水淹。", "两条路一样长，下面那条路边有一家客栈。", "磨坊旁边的那条更短，只是桥太弱，车子过不去。"],
        ["抱歉，我无法回答这个问题。", "很遗憾，我不能帮助您完成这个请求。", "作为助手，我不便回答此类问题。", "我必须拒绝这个请求。", "对不起，我没有办法处理这个问题。"],
    ),
}


def unseen_pairs():
    """(prompt, response, defects): at least 200 pairs over five languages."""
    for own, (prompt, sound, refusals) in UNSEEN.items():
        yield from ((prompt, x, []) for x in sound)
        yield from ((prompt, x, ["refusal"]) for x in refusals)
        yield from ((prompt, f"{prompt} {x}", []) for x in sound)  # restated, then answered
        yield from ((prompt, x, ["copy"]) for x in (prompt, prompt.upper(), f"<answer>{prompt}</answer>", prompt.rstrip("?？ "), f"{prompt} {prompt}"))
        yield from ((prompt, x, []) for x in ("B", "42", "$x = 3$", "\\boxed{7}"))
        yield from ((prompt, x, ["empty"]) for x in ("", " \n", "N/A", "<answer></answer>", None, "null"))
        for other, (_, answers, declines) in UNSEEN.items():
            if other != own:
                yield from ((prompt, x, ["language"]) for x in answers)
                yield prompt, declines[0], ["refusal"]  # a refusal is never also language


def test_unseen_pairs():
    """Precision and recall by type on words that no list was made from."""
    pairs_ = list(unseen_pairs())
    got = [(want, pairs.rules(p, t)) for p, t, want in pairs_]
    assert len(got) >= 200
    for kind in ("empty", "refusal", "copy", "language"):
        true, found = sum(kind in w for w, _ in got), sum(kind in g for _, g in got)
        both = sum(kind in w and kind in g for w, g in got)
        print(f"{kind}: {both} of {true} found, {found} flagged")
        assert both >= 0.9 * true and both >= 0.9 * found


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("I cannot help with this request. The bird is in the tree. It sings all day. The wind is soft. Grass grows by the road.", True), ("As an AI language model, I cannot answer step 1 of your request.", True),
        ("Mi dispiace, non posso aiutarti con questa richiesta.", True), ("Desculpe, não posso responder a esta pergunta.", True), ("Helaas kan ik deze vraag niet beantwoorden.", True),
        ("We cannot divide the rope here, so we take the rest and go on.", False), ("I cannot help with this request. Still, \\boxed{4} is it.", False), ("I cannot simply add them. The answer is 12.", False), ("x" * 100_000, False),
    ],
)
def test_refusals(text, want):
    assert pairs.is_refusal(text) is want


def test_copy_look_changes_nothing():
    """The look at a text's end tells the same as the whole comparison."""
    rnd = random.Random(21)
    old = pairs.LOOK
    cases = []
    for _ in range(300):
        p = text_of(rnd, rnd.randint(5, 60))
        w = p.split() * rnd.randint(1, 4)
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        cases.append((p, " ".join(w + [rnd.choice(WORDS) for _ in range(rnd.choice([0, 0, 1, 5, 40]))])))
    cases += [(p, f"{t} <br> {p.split()[0]}") for p, t in cases[:20]] + [(p, t + " &amp;") for p, t in cases[:20]]
    quick = [pairs.is_copy(p, t) for p, t in cases]
    last = pairs.ends_otherwise
    try:
        pairs.LOOK = 10**9
        pairs.ends_otherwise = lambda p, t: False
        assert quick == [pairs.is_copy(p, t) for p, t in cases] and 20 < sum(quick) < 280
    finally:
        pairs.LOOK, pairs.ends_otherwise = old, last


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (None, truncation.EMPTY), ("", truncation.EMPTY), ("A whole sentence.", truncation.WHOLE), ("It was cut...", truncation.CUT), ("text [output cut]", truncation.CUT), ('{"a": [1, 2', truncation.CUT),
        ('{"a": [1, 2]}', truncation.WHOLE), ("[1, 2, 3", truncation.CUT), ("code\n```python\nx = 1", truncation.CUT), ("a | b\n1 | 2\n3", truncation.CUT), ("r 0 s 1.5\nr 1 s 2.5\nr 2", truncation.CUT),
        ("<think>a b. ", truncation.CUT), ("so \\boxed{12", truncation.CUT), ("The answer is 4", truncation.ASK), ("True", truncation.ASK), ("x" * 100_000, truncation.ASK), ("x " * 100_000, truncation.ASK),
    ],
)
def test_ends(text, state):
    assert truncation.end_of(text)[0] == state


def test_near_copy_that_ends_early(spark):
    rnd = random.Random(3)
    whole = text_of(rnd, 80) + ".\n\n#### 849"
    rows = [(1, whole, "s"), (2, whole[:-1], "s"), (2, whole[:-1], "s"), (3, "True", None), (4, None, "s"), (None, "x", "s")] + [(10 + i, f"{text_of(rnd, 60)}.\n\n#### {rnd.randrange(99)}", "s") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, text string, source string").withColumn("field", F.lit(1))
    got = {r.id: r.cut for r in truncation.judged_ends(df, "f", "id", "text", "source").collect()}
    assert got.pop(2) is True
    assert 4 not in got and not any(got.values())
    assert truncation.judged_ends(df.limit(0), "f", "id", "text", "source").count() == 0


@pytest.mark.parametrize(
    ("short", "long", "want"),
    [
        ("one two three four five six sev", "One two three, four five six seven eight.", True), ("one two three four five six", "One two three, four five six seven eight.", True),
        ("one two three four five six.", "One two three four five six. Seven eight.", False), ("one two three four five six", "One two three four five six. Seven eight.", False),
        ("one two three four (five six)", "one two three four (five six) seven eight", True), ("a b c:\n- one two.\n- three four.", "a b c:\n- one two.\n- three four.\n- five six.", True),
        ("a b c:\n- one two.\n- three four.", "a b c:\n- one two.\n- three four.\nAll in all it ends.", False), ("h | k\n1 | 2\n3 | 4", "h | k\n1 | 2\n3 | 4\n5 | 6", True),
        ("one two three four five six", "other words stand here and not the same as there", False), ("one two three four five six", "one two three four five six", False), ("", "x y", False), ("x", "", False),
    ],
)
def test_ends_early(short, long, want):
    assert truncation.ends_early(short, long) is want


def planted_cuts(rnd, n):
    """Texts, and copies of most of them with small edits that are cut inside a word."""
    whole = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(40, 240))) + "." for _ in range(n)]
    short = []
    for t in whole:
        w = t.split()
        for i in range(len(w)):
            if rnd.random() < 0.02:
                w[i] = rnd.choice(WORDS)
        if rnd.random() < 0.5:
            w.insert(rnd.randrange(len(w)), rnd.choice(WORDS))
        short.append(" ".join(w[: max(20, int(len(w) * rnd.uniform(0.3, 0.95)))])[:-1])
    return whole, short


@pytest.mark.parametrize("hot", [1_000, 8, 0])
def test_cut_copies_are_found(spark, hot):
    rnd = random.Random(9)
    whole, short = planted_cuts(rnd, 150)
    restated = text_of(rnd, 70)  # one bucket that many texts share
    whole += [f"{restated} {text_of(rnd, 30)}." for _ in range(60)]
    short += [t[: len(t) - rnd.randint(5, 90)] for t in whole[-60:]]
    rows = [(i, t) for i, t in enumerate(whole + short + short[:20])]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    ev = truncation.written(truncation.evidence(df.withColumn("g", F.lit("s")), "f", "id", "text", "g"), "ev")
    nodes = {r.id: r.node for r in ev.where("kind = 'v'").collect()}
    early = {r.node for r in truncation.aligned_cuts(df, truncation.near_copies(ev, df, "id", "text", hot), "id", "text").collect()}
    true = {i for i, s in enumerate(short, len(whole)) if any(truncation.ends_early(s, w) for w in whole)}
    got = {i for i, _ in rows if nodes[i] in early}
    print(f"hot {hot}: {len(true & got)} of {len(true)} cut copies found")
    assert len(true & got) >= 0.95 * len(true) and not any(i < len(whole) for i in got)
    assert all(i in got for i in range(len(whole + short), len(rows)) if i - len(short) in true & got)


def test_hot_buckets_lose_nothing(spark):
    rnd = random.Random(10)
    whole, short = planted_cuts(rnd, 80)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(whole + short)], "id long, text string")
    ev = truncation.written(truncation.evidence(df.withColumn("g", F.lit("s")), "f", "id", "text", "g"), "ev")
    early = [{r.node for r in truncation.aligned_cuts(df, truncation.near_copies(ev, df, "id", "text", hot), "id", "text").collect()} for hot in (1_000, 0)]
    assert early[0] == early[1] and len(early[0]) > 60


def test_unmarked_ends_are_whole(spark):
    """Complete sentences without a final mark, of any length, where the corpus writes so."""
    ends = [
        "The committee agreed to publish the findings early next spring", "We can compute the sum directly and the result is 42", "Answer: the train from Leeds arrives at noon on Tuesday morning", "Nothing more was said about it in the long report of the year",
    ]
    words = [x.split()[-1] for x in ends]
    rnd = random.Random(1)
    filler = [f"{text_of(rnd, 9)} {rnd.choice(words)}\n{text_of(rnd, 10)} {rnd.choice(words)}\n{text_of(rnd, 5)} the {text_of(rnd, 3)} {rnd.choice(words)}" for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(ends + ["We can compute the sum directly and the"] + filler)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("g", F.lit("s"))
    got = {r.id: r.cut for r in truncation.judged_ends(df, "f", "id", "text", "g").collect()}
    assert [got[i] for i in range(5)] == [False, False, False, False, True]


def test_pairs_on_tables(spark, sf):
    got = pairs.broken_pairs(read(spark, sf, "rollouts")).collect()
    assert len({r.rollout_id for r in got}) == len(got) and {r.defect for r in got} <= set(pairs.ORDER)
    cut = truncation.judged_ends(read(spark, sf, "rollouts"), "responses", "rollout_id", "responses", "data_source", "prompts").where("cut")
    assert {r.rollout_id for r in got if r.defect == "truncated"} == {r.id for r in cut.collect()}


# ---- 2


def test_packing(spark):
    rnd = random.Random(4)
    n = [min(5_000, int(rnd.paretovariate(1.1) * 20)) for _ in range(600)]
    rows = [(i, [1] * k, None) for i, k in enumerate(n)] + [(0, [1] * n[0], None), (None, [1], None), (9_000, None, None), (9_001, [], []), (9_002, [0, 7, 7, 0], [0, 1, 1, 0])]
    seqs = spark.createDataFrame(rows, "seq_id long, input_ids array<int>, attention_mask array<int>").withColumn("length", F.lit("x"))
    limits = spark.createDataFrame([("a", 512), ("b", 100), (None, 5), ("c", None), ("d", 0)], "pack_name string, capacity int")
    out = packing.fill_containers(seqs, limits, group_items=150, rounds=3).collect()
    for name, cap in (("a", 512), ("b", 100)):
        bins, whole = defaultdict(int), defaultdict(int)
        for r in (r for r in out if r.pack_name == name):
            bins[r.bin_id] += r.length
            whole[r.seq_id] += r.length
        assert max(bins.values()) <= cap and dict(whole) == {**dict(enumerate(n)), 9_002: 2}
        assert len(bins) <= 1.02 * -(-sum(whole.values()) // cap) + 1
        assert {r.seq_id for r in out if r.pack_name == name and r.parts > 1} == {i for i, k in enumerate(n) if k > cap}
    assert packing.fill_containers(seqs.limit(0), limits).count() == 0 and packing.fill_containers(seqs, limits.limit(0)).count() == 0


def test_local_search_only_improves():
    rnd = random.Random(9)
    for _ in range(30):
        sizes = [rnd.randrange(1, 100) for _ in range(60)]
        first = [[i] for i in range(60)]
        bins = packing.local_search(sizes, 100, first)
        assert sorted(i for b in bins for i in b) == list(range(60)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert sum(sum(sizes[i] for i in b) ** 2 for b in bins) >= sum(x * x for x in sizes)


def test_local_search_empties_bins():
    """On many loads best fit decreasing leaves a bin too much that exchanges empty; no item is lost and no bin overflows."""
    fewer = at_bound = 0
    for seed in range(60):
        rnd = random.Random(seed)
        sizes = [rnd.randint(20, 60) for _ in range(rnd.randint(20, 60))]
        first = packing.best_fit_decreasing(sizes, 100)
        last = packing.local_search(sizes, 100, [list(b) for b in first])
        assert sorted(i for b in last for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in last) and len(last) <= len(first)
        fewer += len(last) < len(first)
        at_bound += len(last) == -(-sum(sizes) // 100)
    print(f"{fewer} of 60 loads need fewer bins after the search, {at_bound} the least number by volume")
    assert fewer >= 10


# ---- 4


def links_by_force(docs, t=0.5, least=40):
    """Other documents that each one is linked with."""
    sets = {i: frozenset(zip(w, w[1:], w[2:])) for i, x in docs if x and len(w := T.words(x)) >= least}
    return {a: sum(a != b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) for b in sets) for a in sets}


def groups_by_force(docs, t=0.5, least=40):
    sets = {i: frozenset(zip(w, w[1:], w[2:])) for i, x in docs if x and len(w := T.words(x)) >= least}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n >= t * (len(sets[a]) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    out = defaultdict(set)
    for i in ids:
        out[find(i)].add(i)
    return {frozenset(g) for g in out.values() if len(g) > 1}


@pytest.mark.parametrize("region", [1_000, 8])
def test_near_duplicates(spark, region):
    rnd = random.Random(6)
    docs = [(i, text_of(rnd, rnd.randrange(30, 90))) for i in range(120)]
    base = text_of(rnd, 60).split()
    for i in range(60):  # a third of the rows: one family of near-copies
        w = list(base)
        for _ in range(rnd.randrange(12)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        docs.append((200 + i, " ".join(w)))
    docs += [(300, docs[3][1] + " tail end"), (301, docs[3][1].upper()), (302, None), (303, ""), (304, "short text"), (None, docs[5][1]), (305, " ".join(["same"] * 60)), (306, " ".join(["same"] * 70))]
    df = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").withColumn("node", F.lit(1))
    got, links = defaultdict(set), {}
    for r in neardup.near_duplicates(df, region=region).collect():
        got[r.class_id].add(r.doc_id)
        links[r.doc_id] = r.n_links
    want = links_by_force([d for d in docs if d[0] is not None])
    assert all(n == want[d] or (n is None and region == 8) for d, n in links.items())
    assert {frozenset(g) for g in got.values()} == groups_by_force([d for d in docs if d[0] is not None])
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("family", [3, 40, 400])
def test_metric_join_is_exact(family):
    """Pivots, windows and recursion find the pairs of brute force, whatever the families are."""
    rnd = np.random.default_rng(family)
    sets = []
    while len(sets) < 400:
        base = rnd.integers(0, 10_000, rnd.integers(5, 80))
        for _ in range(family):
            x = base.copy()
            x[rnd.random(len(x)) < rnd.random() * 0.6] = rnd.integers(0, 10_000)
            sets.append(np.unique(np.concatenate((x, rnd.integers(0, 10_000, rnd.integers(0, 20))))).astype(np.uint64))
    sets = sets[:400]
    rnd.shuffle(sets)
    i, j = neardup.metric_join(sets)
    got = set(zip(i.tolist(), j.tolist()))
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if neardup.jaccard(sets[a].tobytes(), sets[b].tobytes()) >= 0.5}
    assert got == want and len(i) == len(got) and len(want) > 30


def test_near_duplicate_pairs(spark):
    c = spark.createDataFrame([(1, 1, 3), (2, 1, 3), (3, 1, 3)], "doc_id long, class_id long, class_size long")
    assert sorted(map(tuple, neardup.pairs_of(c).collect())) == [(1, 2), (1, 3), (2, 3)]


# ---- 6


@pytest.mark.parametrize("index_bytes", [leakage.INDEX_BYTES, 1])
def test_leakage(spark, index_bytes):
    rnd = random.Random(7)
    items = [(i, text_of(rnd, 40)) for i in range(20)] + [(50, None), (51, "too short"), (0, "again")]
    docs = [(i, text_of(rnd, 200)) for i in range(40)] + [(90, None), (91, ""), (None, items[0][1])]
    part = items[5][1].split()
    docs += [(100, f"{text_of(rnd, 50)} {' '.join(part[7:17])} {text_of(rnd, 50)}"), (101, f"{text_of(rnd, 50)} {' '.join(part[7:16])} {text_of(rnd, 50)}")]
    docs += [(102, "<p>" + "<br>\n, ".join(w.upper() for w in part) + "</p>"), (103, text_of(rnd, 30_000) + " " + items[6][1]), (104, items[7][1] + " x " + items[7][1])]
    d = spark.createDataFrame(docs + docs[-1:], "doc_id long, text string").withColumn("item_id", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, question string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r.shared_runs for r in leakage.leaked_items(d, q, index_bytes=index_bytes).collect()}
    assert got == {(100, 5): 1, (102, 5): 31, (103, 6): 31, (104, 7): 31}
    assert leakage.leaked_items(d.limit(0), q, index_bytes=index_bytes).count() == 0 and leakage.leaked_items(d, q.limit(0), index_bytes=index_bytes).count() == 0


def test_window_minima_miss_no_common_run():
    """Every common run of ten words of brute force is met by a minimum, and the minima are few."""
    rnd = random.Random(12)
    items = [text_of(rnd, rnd.randint(8, 60)) for _ in range(60)]
    docs = []
    for _ in range(200):
        w = items[rnd.randrange(60)].split()
        at = rnd.randrange(max(1, len(w) - 9))
        docs.append(f"{text_of(rnd, rnd.randint(0, 300))} {' '.join(w[at : at + rnd.randint(5, 20)])} {text_of(rnd, rnd.randint(0, 90))}")
    ix = leakage.ItemIndex(list(range(60)), items, leakage.RUN)
    got = {(d, i): n for d, i, n, _ in leakage._verified(np.arange(200), docs, ix)}
    want = {}
    for d, t in enumerate(docs):
        runs = leakage.text_runs(t, leakage.RUN)
        want |= {(d, i): n for i, q in enumerate(items) if (n := len(runs & leakage.item_runs(q, leakage.RUN)))}
    assert got == want and len(want) > 80
    h, o = T.word_hashes(docs)
    assert len(leakage.window_minima(h, o)[1]) < 0.4 * len(h)


# ---- 7


def test_mixing(spark):
    rnd = random.Random(8)
    docs = [(i, "a" if i % 3 else "b", text_of(rnd, rnd.randrange(5, 60))) for i in range(900)] + [(2_000, "c", "   "), (2_001, "c", None), (2_002, None, "x y z"), (2_003, "d", "tiny")]
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, source string, text string").withColumn("tokens", F.lit("x"))
    targets = spark.createDataFrame([("m", "a", 0.5, 1, 0.3), ("m", "b", 0.5, 2, 0.3), ("n", "a", 0.3, 1, 0.3), ("n", "d", 0.7, 5, 0.3), ("n", "none", None, 5, 0.3)], "mix_name string, source string, target_share double, max_repeats int, budget_ratio double")
    sizes, planned, picked = mixing.mix(df, targets)
    total = sizes.agg(F.sum("tokens")).first()[0]
    share = {(r.mix_name, r.source): r for r in mixing.shares(planned, picked).collect()}
    for k in (("m", "a"), ("m", "b"), ("n", "a")):
        assert abs(share[k].actual_tokens - share[k].target_tokens) < 0.002 * total
    assert {tuple(r) for r in mixing.unreachable(planned).collect()} == {("n", "d")}
    assert share["n", "d"].most_repeats == 5 and share["n", "none"].actual_tokens == 0
    chosen = defaultdict(set)
    for r in picked.where("source = 'a'").collect():
        chosen[r.mix_name].add(r.doc_id)
    assert chosen["n"] < chosen["m"]  # nested budgets
    _, p, c = mixing.mix(df.limit(0), targets)
    assert c.count() == 0 and p.count() == 5


# ---- 8


@pytest.mark.parametrize(
    ("text", "label"),
    [
        (None, None), ("  ", None), ("<image>", None), ("<answer>5</answer>", None), ("Dear {{name}}, thank you for the long letter.", "slot"), ("Write the slot as `{{name}}` and go on.", None), ("We got $x_{1} + \\frac{1}{2}$ here.", None),
        ("Posted by [your name] on %s. More of the text.", "slot"), ("Use %d for the length, says the printf note.", None), ("The <first_name> of it", "slot"), ("Lorem ipsum dolor sit amet magna elit", "dummy"), ("asdf qwer zxcv asdf", "dummy"),
        ("404 Not Found", "notice"), ("Please enable JavaScript to view this page.", "notice"), ("Seite nicht gefunden", "notice"), ("Grader | Vector\nAccess denied. Retry after 9 s.", "notice"), ("服务器错误，请稍后再试", "notice"),
        ("Readers in the town had to enable JavaScript before the page could draw.", None), ("Pumps move water from the low field to the high field.", None),
    ],
)
def test_residue_labels(text, label):
    assert residue.label_of(text) == label


def test_fingerprint_tables_are_complete(spark):
    rnd = random.Random(10)
    rows = []
    for _ in range(200):
        a = rnd.getrandbits(63)
        b = a
        for bit in rnd.sample(range(63), 3):
            b ^= 1 << bit
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a long, b long").select(F.arrays_overlap(residue.tables_of(F.col("a")), residue.tables_of(F.col("b"))).alias("meet"))
    assert df.where("meet").count() == 200


def test_residue_spreads(spark):
    filler = " ".join("lorem ipsum dolor sit amet magna elit luna".split() * 12)
    # a copy in which so much is foreign that the rule alone does not fire, a copy of the copy, and real text
    rnd = random.Random(11)
    real = [(100 + i, text_of(rnd, 50)) for i in range(30)]
    rows = [(1, filler), (2, filler.upper()), (3, "404 Not Found"), (4, None), (None, "404 Not Found"), (3, "404 Not Found"), *real]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x"))
    assert sorted(r.doc_id for r in residue.residue(df).collect()) == [1, 2, 3]
    assert residue.residue(df.limit(0)).count() == 0


def test_residue_hops(spark):
    """Labels travel along near-copies: the rule fires for the first text only, its copy and the copy's copy follow."""
    rnd = random.Random(12)
    other = ["".join(rnd.choice("bcdfghjk") + rnd.choice("aeiou") for _ in range(4)) for _ in range(3_000)]
    latin = sorted(residue.LATIN)
    w = [rnd.choice(latin) for _ in range(2_800)] + [rnd.choice(other) for _ in range(1_200)]
    rnd.shuffle(w)
    at = [i for i in range(3_990) if sum(x in residue.LATIN for x in w[i : i + 5]) == 5]
    texts = [" ".join(w)]
    for i in (at[0], at[-1]):
        w[i : i + 5] = [rnd.choice(other) for _ in range(5)]
        texts.append(" ".join(w))
    assert [residue.label_of(t) for t in texts] == ["dummy", None, None]
    h, o = T.word_hashes(texts)
    fp = [int(x) for x in residue.simhash(h, o)]
    assert all((a ^ b).bit_count() <= residue.DISTANCE for a, b in zip(fp, fp[1:]))
    real = [(100 + i, text_of(rnd, 50)) for i in range(5)]
    df = spark.createDataFrame([*enumerate(texts), *real], "doc_id long, text string")
    got = {r.doc_id: (r.label, r.hop) for r in residue.residue(df).collect()}
    assert set(got) == {0, 1, 2} and got[0] == ("dummy", 0) and got[1] == ("dummy", 1) and got[2][1] in (1, 2)


def test_residue_reaches_every_near_copy(spark):
    """Copies of filler at similarity 0.8 to 0.95, long and short, against brute force."""
    rnd = random.Random(13)
    latin, other = sorted(residue.LATIN), ["".join(rnd.choice("bcdfghjk") + rnd.choice("aeiou") for _ in range(4)) for _ in range(3_000)]
    rows, seeds, copies = [], [], []
    for n in (9, 11, 30, 60, 150, 400):
        for _ in range(6):
            own = rnd.sample(other, max(1, n * 28 // 100))  # just within the filler rule, so a copy with a little less filler is out of it
            w = own + [rnd.choice(latin) for _ in range(n - len(own))]
            rnd.shuffle(w)
            seeds.append((len(rows), " ".join(w)))
            rows.append(seeds[-1])
            for edits in range(1, 2 + n // 50):
                c = list(w)
                for i in rnd.sample([i for i in range(n) if c[i] in residue.LATIN], edits):
                    c[i] = rnd.choice(other)
                copies.append((len(rows), " ".join(c)))
                rows.append(copies[-1])
    labels = {i: residue.label_of(x) for i, x in rows}
    trusted = [(i, x) for i, x in rows if labels[i] == "dummy"]
    want = {i for i, x in rows if labels[i] or any(residue.similar(x, y) for _, y in trusted)}
    by_rule = {i for i in labels if labels[i]}
    assert len(want - by_rule) >= 10
    df = spark.createDataFrame(rows + [(1_000 + i, text_of(rnd, 50)) for i in range(20)], "doc_id long, text string")
    assert {r.doc_id for r in residue.residue(df, hops=1).collect()} == want


def test_fingerprints_find_near_copies(spark):
    """Recall of the tables and the Hamming check alone, against brute force, over pairs of similarity 0.8 and more."""
    rnd = random.Random(15)
    words = sorted({"".join(rnd.choice("bcdfghjklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(4_000)})
    seeds, copies = [], []
    for n in (30, 60, 120, 300):
        for k in range(12):
            w = [rnd.choice(words) for _ in range(n)]
            seeds.append((len(seeds), " ".join(w), "notice"))
            for edits in range(1, 1 + n // 45 + 1):
                c = list(w)
                for i in rnd.sample(range(n), edits):
                    c[i] = rnd.choice(words)
                copies.append((1_000 + len(copies), " ".join(c), len(seeds) - 1))
    want = {(i, j) for i, x, j in copies if residue.similar(x, seeds[j][1])}
    df = spark.createDataFrame([(i, x) for i, x, _ in seeds + copies], "doc_id long, text string")
    m = residue.written(residue.marked(df), "m")
    got = {(r.doc_id, r.doc_s) for r in residue.hamming_pairs(m.where("doc_id >= 1000"), m.where("doc_id < 1000").withColumn("label", F.lit("notice"))).collect()}
    print(f"tables: {len(want & got)} of {len(want)} pairs, {len(got)} candidates")
    assert len(want) > 100 and len(want & got) >= 0.9 * len(want) and len(got) < 3 * len(want)


def test_residue_without_rules_for_copies(spark):
    """Rules are switched off for all but three notices; their copies come over links."""
    texts = ["The page you asked for could not be found on this server", "Please enable scripts in your browser and reload the page to go on reading this article", "Access to this part of the archive has been denied for your address"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10, "Page not found"), (11, "Page not. Found")]
    rows += [(40, "A baker in the old town sold bread on the page of a newspaper")]
    rows += [(20 + i, f"Home | News | Shop\n{t.upper()}\nRetry after {i} s.") for i, t in enumerate(texts)] + [(30 + i, f"<p>{t}</p>".replace(" the ", " that ")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = residue.written(residue.marked(df).withColumn("label", F.when(F.col("doc_id") < 3, "notice").when(F.col("doc_id") == 10, "notice")), "m")
    got = {r.doc_id: r.hop for r in residue.spread(m, df).collect()}
    print(f"hops without rules: {got}")
    assert {i for i, hop in got.items() if hop == 0} == {0, 1, 2, 10} and {11, 20, 21, 22} <= set(got) and 40 not in got


def test_residue_label_reaches_members_of_its_node(spark):
    """Texts with the words of a labelled one, for which the rule does not fire, and near-copies of one of two close seeds."""
    notice = "The page could not be found on this server"
    other = "The\npage\ncould\nnot\nbe\nfound\non\nthis\nserver"
    assert residue.label_of(notice) == "notice" and residue.label_of(other) is None and residue.similar(notice, other)
    slot = "{name} " + " ".join(f"{a}{b}" for a in "abcdef" for b in "klmnop")
    filled = slot.replace("{name}", "name")
    assert residue.label_of(slot) == "slot" and residue.label_of(filled) is None
    df = spark.createDataFrame([(1, notice), (2, other), (3, slot), (4, filled)], "doc_id long, text string")
    assert {r.doc_id: (r.label, r.hop) for r in residue.residue(df).collect()} == {1: ("notice", 0), 2: ("notice", 1), 3: ("slot", 0)}


def test_residue_follows_long_chains(spark):
    """A chain of small edits, each text similar to the one before it only, is labelled to its end."""
    rnd = random.Random(14)
    other = ["".join(rnd.choice("bcdfghjk") + rnd.choice("aeiou") for _ in range(4)) for _ in range(3_000)]
    w = [rnd.choice(sorted(residue.LATIN)) for _ in range(70)] + rnd.sample(other, 30)
    rnd.shuffle(w)
    texts = [" ".join(w)]
    for i in range(10):
        w[6 * i : 6 * i + 6] = rnd.sample(other, 6)
        texts.append(" ".join(w))
    assert [residue.label_of(x) for x in texts] == ["dummy"] + [None] * 10
    assert all(residue.similar(texts[i], texts[j]) == (abs(i - j) < 2) for i in range(11) for j in range(11))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.hop for r in residue.residue(df).collect()} == {i: i for i in range(11)}
    assert {r.doc_id for r in residue.residue(df, hops=2).collect()} == {0, 1, 2}


#: Notices and texts in words of their own, in several languages.
UNSEEN_NOTICES = [
    "Your access to this portal has been suspended by the administrator.", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.", "Pagina non trovata. Torna alla pagina iniziale.",
    "We're sorry, the page you requested does not exist.", "Error 500: internal server error", "This video is not available in your country.", "Please complete the security check to access the site.",
    "To continue, turn off your ad blocker.", "You need to log in to see this content.", "Session timed out, please sign in again.", "Diese Seite existiert nicht mehr.",
    "Der Server ist vorübergehend nicht erreichbar.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "Cette page n'existe plus.", "Votre session a expiré, veuillez vous reconnecter.",
    "Veuillez activer les cookies pour continuer.", "La página solicitada no existe.", "Su sesión ha caducado.", "Debe habilitar las cookies para continuar.",
    "页面已被删除", "请先登录后查看", "您的浏览器不支持脚本", "系统繁忙，请稍后再试", "HTTP 403 Forbidden", "Connection refused", "Too many requests. Slow down.", "The requested URL was not found on this server.",
    "Object moved permanently.", "This site can't be reached", "502 Bad Gateway", "We use cookies to improve your experience. Accept all cookies.", "Just a moment... Checking if the site connection is secure",
    "Página não encontrada", "Ocorreu um erro inesperado.", "Loading... Please enable scripts.",
]
UNSEEN_TEXTS = [
    "The baker closed the shop at noon and went home.", "A moving van was parked at the gate for two days.", "The error of the estimate is three percent, which is small.",
    "Die Seite des Buches zeigt eine alte Karte der Stadt.", "Cette page du livre montre une vieille carte.", "La página cuarenta del libro muestra un mapa antiguo.",
    "这本书的第四十页有一张旧地图。", "In the lab a server farm used twice the power of the old one.", 'The clerk wrote "404 Not Found" on the board as a joke and all laughed.',
    "A cookie recipe needs butter, sugar and flour.", "Two roads leave the village, one is short and steep.", "The function raises an error when the list is empty, so we check its length first.",
    "Sum the digits and take the rest by nine.", "The bridge was closed for maintenance in spring, and the carters took the lower road.", "JavaScript was made in ten days, as the story goes.",
    "The session of the council lasted until midnight.", "They lost the connection between the two proofs.", "The author of this script lives by the sea.",
    "Der Zugang zum Hof liegt hinter dem alten Tor.", "L'accès au jardin se fait par la cour.",
]


def test_unseen_notices():
    """Precision and recall on notices and on texts with their topics, on words that no list was made from alone."""
    found = [t for t in UNSEEN_NOTICES if residue.label_of(t) == "notice"]
    wrong = [t for t in UNSEEN_TEXTS if residue.label_of(t)]
    print(f"notices: {len(found)} of {len(UNSEEN_NOTICES)}, texts taken for one: {wrong}")
    assert len(found) >= 0.9 * len(UNSEEN_NOTICES) and len(wrong) <= 0.1 * len(UNSEEN_TEXTS)


LONG_NOTICES = [
    "<html><head><title>Error</title></head><body>" + '<div class="wrapper outer-frame" data-role="none"></div>' * 30 + "<p>The page you requested could not be found.</p></body></html>",
    "\n".join(["Home | News | Archive | Forum | Shop | About"] * 30) + "\nAccess to this page is forbidden.",
    "Traceback (most recent call last):\n" + "".join(f'  File "/srv/app/part{i}.py", line {i}, in handler\n    return forward(request, state, limit)\n' for i in range(1, 40)) + "ValueError: no such state",
    "We use cookies to keep your session open. You must accept cookies before you go on. Please enable scripts in your browser and reload the page. " * 8,
]
LONG_TEXTS = [
    "The baker bought a book on JavaScript. A script is a list of steps that a machine takes one by one. Cookies were invented for shops. In the old days scripts ran on paper tape. Many a script was lost in the fire of that year. " * 8,
    "The server error came up once in the night and was fixed. " + "Pumps move water from the low field to the high field. " * 30,
    'A short note on stacks.\nTraceback (most recent call last):\n  File "a.py", line 3, in f\n    g()\nValueError: x\n' + "Read it from below, as the last line tells what went amiss and the lines above tell the way there. " * 10,
]


@pytest.mark.parametrize("text", LONG_NOTICES)
def test_long_notices(text):
    assert len(text) > 900 and residue.label_of(text) == "notice"


@pytest.mark.parametrize("text", LONG_TEXTS)
def test_long_texts_are_no_notices(text):
    assert residue.label_of(text) is None


def test_language_beside_other_defects(spark):
    prompt = "How many of the apples are in the box?"
    rows = [(1, prompt, "Es gibt in der Kiste nicht mehr als vier Äpfel und auch in der ..."), (2, prompt, "Es gibt in der Kiste nicht mehr als vier Äpfel."), (3, prompt, "Leider kann ich dabei nicht helfen."), (4, prompt, "")]
    df = spark.createDataFrame(rows, "rollout_id long, prompts string, responses string").withColumn("data_source", F.lit("s"))
    got = {r.rollout_id: (set(r.defects), r.defect) for r in pairs.broken_pairs(df).collect()}
    assert got[1] == ({"truncated", "language"}, "truncated") and "language" in got[2][0] and "refusal" in got[3][0] and "language" not in got[3][0] and got[4] == ({"empty"}, "empty")
