import pyarrow as pa
from pyspark.sql import functions as F

from brindle.llm import chat, decontaminate, language_id, url_filter
from brindle.llm.queries import QUERIES
from brindle.plans.tables import table

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out(spark):
    got = QUERIES["op5_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    right, n = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.98
    assert got.count() == 1000


def test_language_edge_cases(spark):
    rows = [(i, "the cat and the dog were here " * 3, "en", "x") for i in range(40)] + [(100 + i, "der Hund und die Katze sind hier " * 3, "de", "x") for i in range(40)]
    odd = [(200, None, None, "x"), (201, "", None, "x"), (202, "123 !!", "en", "x"), (None, "der Hund", None, "x"), (203, "und " * 60000, None, "x"), (1, rows[1][1], "en", "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and got[200].score == 0
    assert got[None].lang_pred == "de" and got[203].lang_pred == "de" and got[5].lang_pred == "en"
    assert language_id.identify(docs).count() == len(rows) + len(odd)
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.filter("lang is null")).collect()} == {"und"}


def brute_rule(host, path, rules):
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fit, key=lambda r: (len(r[1]) + len(r[2]), r[1]), default=None)


def test_url_rules_against_brute_force(spark, monkeypatch):
    hosts = ["net", "a.net", "b.a.net", "ab.net", "x.b.a.net", "org", "a.org", "", "A.NET", "a..net", "net."]
    paths = ["", "/", "/x/", "/x/y", "/x/y/z?q=/x", "#f", "?x"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "://", "a://b.a.net/x/://c"]
    rules = [(v, h, p) for v, h, p in [("block", "net", "/"), ("allow", "a.net", "/x/"), ("block", "b.a.net", "/x/y"), ("allow", "org", ""), ("block", "b.a.net", "/"), ("block", "net", "/x/y/z")]]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls + urls[:3])] + [(None, "http://a.net/x/", "c")], "page_id long, url string, host string")
    for per_sweep in (100_000, 2):
        monkeypatch.setattr(url_filter, "RULES_PER_SWEEP", per_sweep)
        got = url_filter.filter_urls(pages, rules).collect()
        assert len(got) == pages.count()
        for r in got:
            best = brute_rule(r.host, r.path, rules)
            assert (r.rule, r.verdict) == ((best[1] + best[2], best[0]) if best else (None, "allow")), r
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_rotation_renders_every_perspective(spark):
    rows = [(1, 0, "ann", "hi", 9), (1, 1, "bob", None, 9), (1, 2, "cy", "yo", 9), (1, 2, "ann", "a", 9), (1, None, "system", "be", 9), (2, 0, "system", "s", 9), (None, 0, None, "x", 9), (None, 0, None, "x", 9)]
    rows += [(3, i, "ann" if i % 2 else "bob", "t" * (i % 7), 9) for i in range(300)]
    talks = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, rendered int")
    got = chat.rotate(talks).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (1, "cy"), (2, None), (None, "unknown"), (3, "ann"), (3, "bob")}
    for conv, who in {(r.conv_id, r.perspective) for r in got}:
        own = sorted((r for r in got if (r.conv_id, r.perspective) == (conv, who)), key=lambda r: r.char_start)
        text = "".join(r.rendered for r in own)
        want = sorted(((t if t is not None else -1, n or "unknown", x or "") for c, t, n, x, _ in rows if c == conv))
        assert [(r.turn if r.turn is not None else -1, r.name) for r in own] == [w[:2] for w in want]
        for r, (_, name, content) in zip(own, want):
            assert text[r.char_start : r.char_end] == r.rendered
            assert r.trained == (name == who)
            if r.trained:
                assert text[r.mask_start : r.mask_end] == content + "<|im_end|>"
            elif name != "system":
                assert r.rendered.startswith(f"<|im_start|>user name={name}\n")
    assert chat.rotate(talks.limit(0)).count() == 0


def test_rotation_is_native(spark):
    plan = QUERIES["op7_chat_rotation"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


ITEM = "A train leaves Berlin for Munich at 15 km per hour and then Anna waits 20 minutes before the second train starts to move on"


def test_decontamination_finds_templates_with_consistent_slots(spark):
    same = ITEM.replace("Berlin", "Lyon").replace("15", "99").replace("Anna", "Marie Curie").replace("20", "7")
    broken = ITEM.replace("Berlin", "Lyon").replace("Munich", "Lyon")
    clean = "A train leaves the station on time and nobody waits for anything here, the rest of this text is about other things entirely. " * 3
    docs = [(1, "Before it. " + ITEM + ". After it."), (2, same), (3, broken), (4, clean), (5, None), (6, ""), (7, "Filler words go here. " * 9000 + ITEM), (None, ITEM), (1, ITEM), (8, ITEM.upper().lower())]
    bench = [(10, ITEM), (11, None), (12, "too short"), (13, ""), (10, ITEM), (14, "exactly five words are here")]
    docs.append((9, "And so: exactly five words are here"))
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*x, 1) for x in bench], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(d, b).collect()}
    assert got >= {(1, 10), (2, 10), (7, 10), (9, 14)} and not {x for x, _ in got} & {3, 4, 5, 6, None}
    kept = decontaminate.remove(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} >= {3, 4, 5, 6, None}
    assert decontaminate.find(d.limit(0), b).count() == decontaminate.find(d, b.limit(0)).count() == 0


def test_decontamination_equals_containment(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontamination"](spark, SF).collect()}
    assert got == want


def test_templates():
    tokens, values, opens = decontaminate.templates(pa.array(["It cost 1,000.50 dollars, said Ann Lee. Then", "", "5 kg"]))
    assert opens.tolist() == [0, 7, 7, 9]
    assert (values != 0).tolist() == [False, False, True, True, False, True, False, True, True]


def found(spark, docs, bench):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.find(d, spark.createDataFrame(bench, "item_id long, text string")).collect()}


def test_decontamination_finds_items_without_windows(spark):
    items = {1: "What Is The Capital Of France?", 2: "12 + 30 * 4 - 7 = ?", 3: "Why so?", 4: "今日の天気はどうですか", 5: "水", 6: "= ?! ⇒ ∅", 7: "NAME ALL OF THE PLANETS THAT HAVE RINGS", 8: "42", 9: " \n", 10: "Sum 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9"}
    docs = [(i, f"Words before it, {x} and words after it") for i, x in items.items()]
    docs += [(21, "what is the capital of france"), (22, "彼は今日の天気はどうですかと聞いた"), (23, "why, so"), (31, "the capital of France is what"), (32, "12 + 30 * 4 - 8 = ?"), (33, "420 whys so"), (34, "= ?! ⇒"), (35, "Sum 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8")]
    got = found(spark, docs, [*items.items(), (3, "Or another text?")])
    assert got == {(i, i) for i in items if i != 9} | {(21, 1), (22, 4), (23, 3), (32, 2)}


def test_decontamination_whatever_the_capitals(spark):
    story = "Anna buys 3 apples and eats 2. Anna gives 4 pears to her brother.\nHow many apples does Anna have left?"
    wrapped = "On Monday the old teacher Maria Silva told Peter Brown and young Julia Weber that all of the trains to Hamburg are late"
    items = [(10, ITEM), (11, story), (12, wrapped), (13, "Berlin is the capital of Germany")]
    docs = [(8, ITEM.upper().lower()), (9, ITEM.upper()), (3, ITEM.replace("Berlin", "Lyon").replace("Munich", "Lyon"))]
    docs += [(21, story.replace("Anna", "Bob").replace("3", "7")), (22, "So it says. " + story.replace("Anna", "Bob").replace("\n", " "))]
    docs += [(31, wrapped.replace(" Maria", "\nMaria").replace(" Peter", "\r\n  Peter").replace("Weber", "Meyer").replace("Hamburg", "Bern"))]
    docs += [(41, "I know that Berlin is the capital of Germany, as we all do")]
    assert found(spark, docs, items) == {(8, 10), (9, 10), (21, 11), (22, 11), (31, 12), (41, 13)}


def test_decontamination_finds_long_quotations(spark):
    context = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} runs" for i in range(60))
    quoted = "which of the two old bridges over the river was closed first after the flood"
    items = [(10, f"{context}. {quoted}?"), (11, "Count 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 and tell me which number of these comes after all of the others that you have seen so far")]
    words = quoted.split()
    docs = [(1, f"They asked {quoted} and left"), (2, f"They asked {quoted.upper()}"), (3, "They asked " + " ".join(words[:13])), (4, "They asked " + " ".join(words[:12])), (5, " ".join(words[:7] + ["and"] + words[7:]))]
    docs.append((6, "From 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 on"))
    assert found(spark, docs, items) == {(1, 10), (2, 10), (3, 10)}


TEMPLATES = [
    "A shop sells {n} pens for {m} dollars each. How much do {k} pens cost?", "{A} has {n} apples and gives {m} of them to {B}. How many apples does {A} have left?", "Compute {n} + {m} - {k} * {j}.",
    "If a car drives {n} km in {m} hours, what is its average speed?", "What is {n} times {m}?", "{A} is {n} years older than {B}, who is {m}. How old is {A}?", "Solve for x: {n}x + {m} = {k}", "{n} + {m} * {k} = ?",
    "A tank holds {n} liters and loses {m} liters every hour. After how many hours is it empty?", "Convert {n} miles to kilometers and round to {m} digits.",
]


def test_recall_on_changed_parameters(spark):
    """Ten copies of ten templates, each with other numbers and names; none of texts whose slots contradict each other or that only look alike."""
    import random

    r = random.Random(3)
    names = "Anna Bob Carla Dmitri Elena Faruk Greta Hugo Ines Jonas Kofi Lena".split()

    def made(t):
        a, b = r.sample(names, 2)
        n, m, k, j = r.sample(range(2, 999), 4)
        return t.format(A=a, B=b, n=n, m=m, k=k, j=j)

    items = [(i, made(t)) for i, t in enumerate(TEMPLATES)]
    docs = [(100 * i + c, "We talked about school. " + made(t) + " That was it.") for i, t in enumerate(TEMPLATES) for c in range(10)]
    clean = [(2000 + c, f"Compute {c} and {c + 1} - {c + 2} then {c + 5}. A car drove {c} km. {names[c]} has {c} pears and sells {c + 3} of them.") for c in range(10)]
    got = found(spark, docs + clean, items)
    hit = {d for d, i in got if d // 100 == i}
    assert len(hit) / len(docs) >= 0.9 and not [x for x in got if x[0] >= 2000] and not [x for x in got if x[0] < 2000 and x[0] // 100 != x[1]]


def plain_template(text, capitals=False):
    """(token, value or None) of ASCII prose, one by one: numbers, units after numbers, capitalised words within a sentence and the ones after them."""
    import re

    out, ended, before_number, gap = [], True, False, ""
    for m in re.finditer(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", text):
        t = m[0]
        if not t[0].isalnum():
            gap = t
            ended |= bool(set(t) & set('.!?:;"')) or "\n\n" in t
            continue
        if t.isdigit():
            if out and out[-1][0] == "#" and before_number and gap in (".", ","):
                out[-1] = ("#", out[-1][1] + "," + t)
            else:
                out.append(("#", t))
            before_number = True
        else:
            if before_number and gap.strip() == "" and len(gap) <= 1 and t.lower() in decontaminate.UNITS:
                out.append(("unit", t.lower()))
            elif t[0].isupper() and (capitals or not ended):
                if out and out[-1][0] == "name" and gap == " " and not ended:
                    out[-1] = ("name", out[-1][1] + " " + t.lower())
                else:
                    out.append(("name", t.lower()))
            else:
                out.append((t.lower(), None))
            before_number = False
        ended, gap = False, ""
    return out


def plain_match(d, i):
    """(share, whether 13 tokens in a row) of the item's windows with three words or more that stand in the document, each diagonal with values one to one."""
    size = min(8, len(i))
    spots = [p for p in range(len(i) - size + 1) if sum(v is None for _, v in i[p : p + size]) >= 3]
    keys = {p: tuple(t for t, _ in i[p : p + size]) for p in spots}
    lines = {}
    for q in range(len(d) - size + 1):
        for p in spots:
            if tuple(t for t, _ in d[q : q + size]) == keys[p]:
                lines.setdefault(q - p, []).append((p, q))
    matched, row = set(), False
    for own in lines.values():
        pairs = {(i[p + k][1], d[q + k][1]) for p, q in own for k in range(size) if i[p + k][1]}
        if len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs):
            matched |= {keys[p] for p, _ in own}
            at = {p for p, _ in own}
            row |= any(all(p + k in at for k in range(6)) for p in at)
    return (len(matched) / len(set(keys.values())) if spots else 0.0), row


def test_decontamination_equals_plain_template_matching(spark):
    import random

    r = random.Random(8)
    names = "Anna Bob Carla Dmitri Elena Faruk".split()
    words = "the old train leaves early and nobody knows why it stops near that bridge for so long each winter".split()

    def sentence():
        return " ".join(r.choice([*words, r.choice(names), str(r.randint(1, 60)), f"{r.randint(2, 9)} km"]) for _ in range(r.randint(10, 24)))

    def changed(text):
        out = [r.choice(names) if w in names and r.random() < 0.5 else str(r.randint(1, 60)) if w.isdigit() and r.random() < 0.5 else w for w in text.split()]
        a = r.randint(0, len(out) - 1)
        return " ".join(out[:a] + ([r.choice(words)] if r.random() < 0.4 else []) + out[a:] if r.random() < 0.7 else out[a // 2 :])

    items = [(i, "so " + sentence()) for i in range(12)]
    docs = [(100 + k, f"then {sentence()} {changed(r.choice(items)[1])} and {sentence()}") for k in range(150)]
    lower = lambda text: [(w, None if not w.isdigit() else "") for w in text.lower().split()]
    sure, possible = set(), set()
    for d, t in docs:
        for i, x in items:
            by_kind = [plain_match(plain_template(t, c), plain_template(x, c)) for c in (False, True)]
            sure |= {(d, i) for share, row in by_kind if share >= 0.5 or row}
            share, row = plain_match(lower(t), lower(x))
            possible |= {(d, i)} if share >= 0.5 or row else set()
    got = found(spark, docs, items)
    # equal tokens count too, unless templates contradict each other there
    assert sure <= got <= sure | possible and len(sure) > 20 and len(sure) < len(docs) * len(items) / 4


def test_language_filter_against_plain_sets(spark):
    """Masks and scores as plain sets of n-grams give them, but for the filter's false positives; more languages than one word of bits holds."""
    import collections

    rows = [(40 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in ("ato", "beru", "cimi", "dolan")), f"l{k:02}") for k in range(70) for i in range(6)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.table.shape[0] == 2 and sorted(model.languages) == sorted({x for _, _, x in rows})

    def grams(text):
        line = " " + " ".join(text.lower().split()) + " "
        return [line[i : i + 4] for i in range(len(line) - 3)]

    uses = collections.defaultdict(collections.Counter)
    for _, t, x in rows:
        uses[x].update(grams(t))
    rate = {x: {g: n / sum(own.values()) for g, n in own.items() if n >= language_id.LEAST} for x, own in uses.items()}
    highest = collections.defaultdict(float)
    for own in rate.values():
        for g, v in own.items():
            highest[g] = max(highest[g], v)
    held = {x: {g for g, v in own.items() if v >= language_id.SHARE * highest[g]} for x, own in rate.items()}
    texts = [t for _, t, _ in rows] + ["beru cimi", "aaato zzz", "nothing here at all"]
    langs, scores, counts = model.judge(pa.array(texts))
    for text, lang, score, n in zip(texts, langs, scores, counts):
        own = grams(text)
        share = {x: sum(g in s for g in own) / len(own) for x, s in held.items()}
        assert n == len(own) and abs(score - max(share.values())) < 0.02
        assert share[lang] >= max(share.values()) - 0.02
    assert langs[: len(rows)] == [x for _, _, x in rows]

