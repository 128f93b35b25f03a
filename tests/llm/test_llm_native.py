"""Chat formatting, personal data and fingerprints against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from nubila.llm import chat, fingerprint, pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


HARD = [
    None,
    "",
    "no data",
    "a@b.co_x@d.com, x@y z@q.r.s-t. \U0001f600 me@host.io",
    "1.2.3.4.5.6.7.8 256.1.1.1 00000255.0.0.1 1.2.3 9999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 5500005555555559",
    "+1 (456) 555-2186 +12345 ++44 20 7946 0958 +1..........2",
    "a@b.c +4420794609581234567 1.1.1.1",
    "9" * 50_000 + " " + "a" * 50_000 + "@ " + "1." * 20_000,
    "a.b@c" * 2000 + ".de " + "x@y.zz " * 300,
]


def test_pii_base_equals_plain_search(spark, small):
    texts = HARD + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(400).collect()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r["doc_id"]: r["s"] for r in pii.find_base(docs).select("doc_id", pii.spans_text(F.col("base")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_spans(t or ""), (i, (t or "")[:80])


def test_pii_query_digest(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op3_pii_sanitise(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k + ":") for s in base.split(",")) for k in BASE]


def test_pii_terms_that_reveal_an_entity(spark):
    fill = "the of and for with this that from have been were they said which their would there could about other".split()
    rows = [(i, f"{' '.join(fill[i % 7 :])} write to Zanzibar office at boss@corp.example now {' '.join(fill[: i % 9])} {i}") for i in range(6)]
    rows += [(100 + i, " ".join(fill) + f" office now write number {i}") for i in range(60)]
    rows += [(300, None), (301, ""), (302, rows[0][1]), (302, rows[0][1])]
    out = {r["doc_id"]: r for r in pii.sanitise_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        assert "Zanzibar" not in out[i]["sanitised"] and "boss@" not in out[i]["sanitised"]
        assert "[EMAIL]" in out[i]["sanitised"] and "office" in out[i]["sanitised"]
    assert out[100]["sanitised"] == out[100]["text"]
    assert out[300]["sanitised"] == "" == out[301]["sanitised"]
    assert out[302]["sanitised"].count("[TERM]") == out[0]["sanitised"].count("[TERM]") == 1
    assert pii.sanitise_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pii_terms_far_from_the_entity(spark):
    """Evidence counts, and terms go, at any distance in the documents that hold the entity, and nowhere else."""
    gap = " ".join(f"filler{i % 50}" for i in range(60))
    rows = [(i, f"Quillfeather Report {i}. {gap} mail boss@corp.example or call. {gap} {i} signed QUILLFEATHER, boss") for i in range(4)]
    rows += [(50, rows[0][1]), (51, "Quillfeather alone " + gap), (52, f"once@corp.example {gap} Hapaxword")]
    rows += [(100 + i, f"report mail call signed boss {gap} {i}") for i in range(400)]
    out = {r["doc_id"]: r for r in pii.sanitise_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (0, 1, 2, 3, 50):
        text = dict(rows)[i]
        assert out[i]["sanitised"] == re.sub("(?i)quillfeather", "[TERM]", text).replace("boss@corp.example", "[EMAIL]")
        assert [out[i]["text"][s["start"] : s["end"]].lower() for s in out[i]["spans"]] == ["quillfeather", "boss@corp.example", "quillfeather"]
    assert out[51]["sanitised"] == out[51]["text"] and out[100]["sanitised"] == out[100]["text"]
    assert out[52]["sanitised"] == out[52]["text"].replace("once@corp.example", "[EMAIL]")


def test_pii_overlaps_are_replaced_once(spark):
    docs = spark.createDataFrame([(1, "call +1.2.3.4.5678901 or +4111111111111111 end")], "doc_id long, text string")
    r = pii.sanitise_documents(docs).first()
    assert not re.search(r"\d{4}", r["sanitised"]) and r["sanitised"].startswith("call [") and r["sanitised"].endswith(" end")


def brute_terms(texts, alpha=1.5, support=3):
    """Spans of revealing terms by plain loops over all documents."""
    import math

    runs = lambda t: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t)]
    base = [[(int(a), int(b), k) for k, a, b in (x.split(":") for x in brute_spans(t).split(",") if x)] for t in texts]
    words = [{w for _, _, w in runs(t) if len(w) >= 3} for t in texts]
    outside = [{w for a, b, w in runs(t) if len(w) >= 3 and not any(s < b and a < e for s, e, _ in spans)} for t, spans in zip(texts, base, strict=True)]
    held = [{f"{k}:{t[a:b].lower()}" for a, b, k in spans} for t, spans in zip(texts, base, strict=True)]
    n, reveals = len(texts), defaultdict(set)
    for entity in set().union(*held):
        docs = [i for i in range(n) if entity in held[i]]
        if len({texts[i].lower() for i in docs}) < support:
            continue
        for term in set().union(*(outside[i] for i in docs)):
            both = [i for i in docs if term in outside[i]]
            if len({texts[i].lower() for i in both}) >= support:
                mutual = math.log2(len(both) * n / (len(docs) * sum(term in w for w in words)))
                if mutual / max(math.log2(n / len(docs)), 1e-9) >= 1 / alpha:
                    reveals[entity].add(term)
    out = []
    for t, spans, own in zip(texts, base, held, strict=True):
        terms = set().union(*(reveals[e] for e in own)) if own else set()
        out.append(sorted((a, b, w) for a, b, w in runs(t) if w in terms and not any(s < b and a < e for s, e, _ in spans)))
    return out


def test_pii_terms_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    common, rare = [f"word{i}" for i in range(40)], [f"Name{i}" for i in range(30)]
    texts = []
    for _ in range(220):
        own = rng.choices(common, k=rng.randint(3, 25))
        if rng.random() < 0.5:
            k = rng.randrange(12)
            own += [f"mail{k}@corp.example"] * rng.randint(1, 2) + [rare[k]] * rng.randint(0, 2) + ([f"+1 (456) 555-21{k:02d}"] if k % 3 == 0 else [])
        own += rng.choices(rare, k=rng.randint(0, 2))
        rng.shuffle(own)
        texts.append(rng.choice([" ", ", ", "\n"]).join(own) + rng.choice(["", ".", "x@y.zz"]))
    texts += texts[:10]
    rows = pii.sanitise_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    want, fired = brute_terms(texts), 0
    for r in rows:
        mine = sorted((s["start"], s["end"], s["value"]) for s in r["spans"] if s["rank"] == len(pii.KINDS))
        assert mine == want[r["doc_id"]], texts[r["doc_id"]]
        fired += len(mine)
    assert fired > 50


def test_pii_and_chat_deal_hot_texts(spark, monkeypatch):
    """Many copies of one text give the results they give without being dealt over tasks."""
    from nubila.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 3)
    test_pii_terms_that_reveal_an_entity(spark)
    test_pii_terms_far_from_the_entity(spark)


def test_stored_intermediates_can_be_dropped(spark):
    import os

    from nubila.llm import common

    common.drop_stored(spark)
    kept = common.stored(spark.range(3), "kept")
    path = common._GIVEN[-1]
    assert kept.count() == 3 and os.path.exists(path)
    assert common.drop_stored(spark) == 1 and not os.path.exists(path)


def test_a_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as Some

    from nubila.llm import common

    unset = Some(isDefined=lambda: False)
    context = Some(master="spark://host:7077", _jsc=Some(sc=lambda: Some(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError):
        common.shared_root(Some(conf=Some(get=lambda key, default: default), sparkContext=context))


def test_pii_very_many_spans(spark):
    """A hundred thousand spans in one text, each found and replaced."""
    text = " ".join(f"a{i}@b{i % 97}.example" for i in range(100_000))
    r = pii.sanitise_documents(spark.createDataFrame([(1, text), (2, "a1@b1.example")], "doc_id long, text string")).where("doc_id = 1").select(F.size("base").alias("n"), "sanitised").first()
    assert r["n"] == 100_000 and r["sanitised"] == " ".join(["[EMAIL]"] * 100_000)


def test_chat_very_many_turns(spark):
    """A hundred thousand turns in one conversation, read back."""
    rows = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit(0).alias("place"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</s> t"), F.col("id")).alias("text"))
    out = chat.format_conversations(rows)
    r = out.select(F.size(chat.parse_conversation(F.col("formatted"))).alias("n"), F.md5(chat.loss_text(F.col("formatted"), F.col("loss_spans"))).alias("loss")).first()
    assert r["n"] == 100_000 and r["loss"] == hashlib.md5("".join(f"</s> t{i}" for i in range(1, 100_000, 2)).encode()).hexdigest()


def test_chat_round_trip_of_the_conversations(spark, small):
    want = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{small}/conversations.parquet").collect(), key=lambda r: r["turn"]):
        want[r["conv_id"]].append((r["role"], r["text"] or ""))
    hard = "</s>[INST] ok [/INST]"
    want[-7] = [("user", hard), ("assistant", hard)]
    rows = {r["conv_id"]: r for r in queries.op5_chat_format(spark, small).collect()}
    assert set(rows) == set(want)
    for k, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = rows[k]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_escapes_are_reversible(spark):
    texts = ["<|end|>", "\\", "\\\\<|", "<\\|turn|>", "[INST][/INST]<s></s><<SYS>>", "a<|text|>b\\", "\n\n", "", None, "<" * 30 + "|" * 30, "x" * 100_000]
    rows = [(1, i, 0, "assistant" if i % 2 else None, t) for i, t in enumerate(texts)] + [(None, 0, 0, "<|end|>", "t"), (2, 5, 0, "u", "b"), (2, 5, 0, "u", "a"), (2, 5, 0, "u", "a")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, place int, role string, text string"))
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.parse_conversation(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [t["text"] for t in got[1]["t"]] == [t or "" for t in texts]
    assert got[1]["l"] == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert not re.search(r"</?s>|\[/?INST\]", got[1]["formatted"])
    assert got[None]["t"][0]["role"] == "<|end|>"
    assert [t["text"] for t in got[2]["t"]] == ["a", "a", "b"]


@pytest.mark.parametrize(
    "json,layout,turns",
    [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "conversations", [("user", "a"), ("assistant", "b")]),
        ('{"response":"b","prompt":"a"}', "prompt_response", [("user", "a"), ("assistant", "b")]),
        ('{"instruction":"a","input":"","output":"c"}', "instruction_input_output", [("user", "a"), ("assistant", "c")]),
        ('{"instruction":"a","input":"b","output":"c"}', "instruction_input_output", [("user", "a\n\nb"), ("assistant", "c")]),
        ('{"prompt":1.5,"completion":true}', "prompt_completion", [("user", "1.5"), ("assistant", "true")]),
        ('{"other":{"x":[1]}}', None, []),
        (None, None, []),
    ],
)
def test_chat_layouts_by_fingerprint(spark, json, layout, turns):
    df = spark.createDataFrame([(json,)], "j string").select(F.parse_json("j").alias("record"))
    r = chat.canonical_turns(df).select("layout", "turns").first()
    assert r["layout"] == layout and [(t["role"], t["text"]) for t in r["turns"]] == turns


def test_fingerprint_query_against_plain_python(spark, small):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()), reverse=True)
    rows = {r["doc_id"]: r for r in queries.op9_scaled_sketch(spark, small).collect()}
    assert len(rows) == len(docs)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    error = []
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        if len(a) > 200:
            error.append(abs(r["near_edited"] - len(a & b) / len(a | b)))
        assert 0 <= r["near_next"] <= 1
    assert sum(error) / len(error) < 0.06


def test_fingerprint_edges(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (4, "one two"), (None, "a b c d e f"), (5, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, sketch int")
    own = fingerprint.fingerprint_documents(docs)
    led = fingerprint.with_next(own, ("text",), ranges=3).collect()
    assert len(led) == len(rows)
    got = {r["doc_id"]: r for r in led}
    assert got[3]["sketch"] == got[4]["sketch"] and len(got[3]["sketch"]) == 1 and got[1]["sketch"] == [] == got[2]["sketch"]
    assert got[5]["next_text"] == "one two" and got[2]["next_text"] == "" and got[None]["next_text"] == "w " * 50_000
    assert fingerprint.with_next(fingerprint.fingerprint_documents(docs.limit(0)), ("text",)).count() == 0


def test_sketches_merge_and_contain(spark):
    one, two = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(1000))
    df = spark.createDataFrame([(one, two)], "a string, b string").withColumn("wa", fingerprint.words(F.col("a"))).withColumn("wb", fingerprint.words(F.col("b")))
    s = df.select(fingerprint.sketch("wa").alias("a"), fingerprint.sketch("wb").alias("b"))
    r = s.select(fingerprint.containment(F.col("b"), F.col("a")).alias("c"), fingerprint.likeness(F.col("a"), F.col("b")).alias("l"), (fingerprint.merged(F.array("a", "b")) == F.col("a")).alias("m")).first()
    assert r["c"] == 1.0 and abs(r["l"] - 0.25) < 0.05 and r["m"]


def test_sketches_of_short_texts(spark):
    """Texts of few words have sketches, differ where they differ, and compare exactly; long ones merge with short ones."""
    texts = [" ".join(f"t{i}w{k}" for k in range(5 + i % 36)) for i in range(300)]
    df = spark.createDataFrame([(t, texts[i - 1], t + " more") for i, t in enumerate(texts)], "a string, b string, c string")
    s = df.select(*[fingerprint.words(F.col(c)).alias(c) for c in "abc"]).select(*[fingerprint.sketch(c).alias(c) for c in "abc"])
    rows = s.select("a", fingerprint.likeness(F.col("a"), F.col("b")).alias("other"), fingerprint.likeness(F.col("a"), F.col("c")).alias("edited")).collect()
    for i, r in enumerate(rows):
        n = 1 + i % 36
        assert len(r["a"]) == n and r["other"] == 0.0 and r["edited"] == n / (n + 1)
    long = " ".join(f"w{i}" for i in range(3000))
    pair = spark.createDataFrame([(long, "w1 w2 w3 w4 w5 w6", "a b c d e f " + long, "", None)], "a string, b string, c string, e string, n string")
    pair = pair.select(*[fingerprint.words(F.coalesce(c, F.lit(""))).alias(c) for c in "abcen"]).select(*[fingerprint.sketch(c).alias(c) for c in "abcen"])
    like, holds = (lambda f: lambda x, y: f(F.col(x), F.col(y)))(fingerprint.likeness), (lambda f: lambda x, y: f(F.col(x), F.col(y)))(fingerprint.containment)
    r = pair.select(like("a", "b").alias("ab"), like("e", "n").alias("en"), like("e", "b").alias("eb"), holds("b", "a").alias("ba"), holds("e", "a").alias("ea"), like("a", "c").alias("ac"), (fingerprint.merged(F.array("a", "b")) == F.col("a")).alias("m")).first()
    assert r["ab"] < 0.01 and r["en"] == 1.0 == r["ea"] and r["eb"] == 0.0 and r["ba"] in (None, 1.0) and r["ac"] > 0.98 and r["m"]


def test_short_documents_of_the_fingerprint_query(spark, small):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()), reverse=True)
    rows = {r["doc_id"]: r for r in queries.op9_scaled_sketch(spark, small).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} if t.split() else set()
    short = 0
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        a, b, c = shingles(text), shingles(text[: len(text) - len(text) // 2] + after[: len(text) // 2]), shingles(after)
        assert bool(rows[i]["fingerprint"]) == bool(a)
        for other, got in ((b, rows[i]["near_edited"]), (c, rows[i]["near_next"])):
            if max(len(a), len(other)) < fingerprint.LEAST:
                short += 1
                assert abs(got - (len(a & other) / len(a | other) if a | other else 1.0)) < 1e-12
    assert short > 50
