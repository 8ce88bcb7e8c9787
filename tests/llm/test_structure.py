"""Conversation repair, ids in ORC files and centroids against brute force and SQL, and on odd rows."""

import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow.orc
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import centroids, fertility, langid, oracles, orcids, phrases, queries, repair

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_repair", "op13_centroids"])
def test_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    df = queries.queries()[name](spark, SF)
    own = db.sql(oracles.SQL[name])
    assert sorted(df.columns) == sorted(own.columns)
    assert sorted(map(tuple, df.select(*own.columns).collect())) == sorted(own.fetchall())


def inserted(states):
    out = dict(states)
    for _ in range(3):
        for k, (cost, audit, lines) in list(out.items()):
            to, role = ("u", "user") if k != "u" else ("a", "assistant")
            new = (cost + 5, audit + "I", lines + (role + ":",))
            if to not in out or new[:2] < out[to][:2]:
                out[to] = new
    return out


def repaired(rows):
    """The columns of repair.repaired for one conversation, a row at a time."""
    rows = sorted((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows)
    seen, states, faults = set(), {"e": (0, "", ())}, [0, 0, 0]
    for _, _, role, text in rows:
        bare, fault = text.strip(SPACE), None
        if not bare:
            fault = 0
        elif (role, text) in seen:
            fault = 1
        elif bare[-1] not in ".!?":
            fault = 2
        seen.add((role, text))
        new = {}
        if fault is not None:
            faults[fault] += 1
        for k, (cost, audit, lines) in inserted(states).items():
            ways = [(k, 2, "D", lines)]
            if fault in (None, 2):
                extra = 5 if fault == 2 else 0
                for to, price, letter, name in ((role[:1], 0, "K", role), ("u", 1, "R", "user"), ("a", 1, "R", "assistant")):
                    if (k, to) in {("e", "s"), ("e", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                        ways.append((to, price + extra, letter, lines + (f"{name}:{text}",)))
            for to, price, letter, said in ways:
                found = (cost + price, audit + letter, said)
                if to not in new or found[:2] < new[to][:2]:
                    new[to] = found
        states = new
    ends = inserted(states)
    cost, audit, lines = min((ends[k] for k in "ea" if k in ends), key=lambda x: x[:2])
    known = [t for has, t, _, _ in rows if has]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *faults, illegal, cost, audit, "\n".join(lines)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(11)

    def some(n, turns):
        roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
        texts = ["Hi.", "Yes!", "no", "  ", "", None, "Fine.\n", "abc?", "end "]
        return [(rng.choice([None, *range(turns)]), rng.choice(roles), rng.choice([*texts, f"x {rng.randint(0, 9)}."])) for _ in range(n)]

    found = {k: some(rng.randint(1, 9), rng.choice([3, 6, 20])) for k in range(120)}
    found[None] = some(20, 10)
    found[500], found[501] = some(700, 900), some(300, 5)
    found[502] = [(1, "user", "same.")] * 300 + [(2, "assistant", "ok.")]
    found[503] = [(-(1 << 63), "user", "a."), ((1 << 63) - 1, "assistant", "z" * 200_000 + ".")]
    return found


@pytest.mark.parametrize("block", [64, 3])
def test_repair(spark, conversations, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = [(c, t, r, x, 0, "n") for c, own in conversations.items() for t, r, x in own]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at int, conv string")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired(df).collect()}
    want = {c: repaired(own) for c, own in conversations.items()}
    want[503] = (None if want[503][0] >= 1 << 63 else want[503][0], *want[503][1:])
    assert got[503][0] == 0  # a gap that no long can hold
    assert {c: v for c, v in got.items() if c != 503} == {c: v for c, v in want.items() if c != 503}
    assert got[503][1:] == want[503][1:]
    shown = {}
    for r in repair.turns(df).collect():
        shown.setdefault(r["conv_id"], []).append(((r["at"] is None, r["at"] or 0, r["k"]), f"{r['role']}:{r['text']}"))
    assert all("\n".join(x for _, x in sorted(shown.get(c, []))) == want[c][-1] for c in want)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired(df).count() == repair.turns(df).count() == repair.report(df, df).count() == 0
    gone = spark.createDataFrame([(7, k, "user", "x.") for k in range(200)], df.schema)
    left = [k for k in range(200) if zlib.crc32(f"7:{k}".encode()) % 20]
    assert {r["turn"] for r in repair.damaged(gone).collect()} == set(left)
    none = repair.report(df, gone).first()
    assert tuple(none)[:8] == (7, 0, 0, 0, 0, 0, 0, "") and none["repaired_sha256"].startswith("e3b0c442")


def test_repair_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    plan = repair.report(repair.damaged(df), df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


TEXTS = [None, "", "a", "hello world <|endoftext|> x", "é ü 漢字 😀", "word " * 40_000, " " * 10_000, "same", "same"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(k - 2, t) for k, t in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id"), (None, None)]
    rows += [(k, f"text {k} of many") for k in range(100, 6000)]
    random.Random(2).shuffle(rows)
    path = str(tmp_path_factory.mktemp("orc") / "ids")
    orcids.write(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, start int"), queries.PLACE, path)
    return rows, path


def test_orc_round_trip(spark, stored):
    rows, path = stored
    got = sorted(orcids.digests(orcids.read(spark, path)).collect(), key=lambda r: r["start"])
    code = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = {}
    for k, t in rows:
        ids = np.array([*code.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own.setdefault(k, []).append((len(ids), zlib.crc32(ids.tobytes())))
    found, at = {}, 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert [r["doc_id"] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in own.items()}


def scanned(df):
    """Rows that the scan of the ids gave out."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if "Scan orc" in node.nodeName() and "n_tokens" in node.toString():
            out.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return sum(out)


def test_orc_reads_skip_row_groups(spark, stored):
    _, path = stored
    every = orcids.read(spark, path)
    assert scanned(every) > 5000
    one = every.where("doc_id = 4321")
    assert [r["doc_id"] for r in one.collect()] == [4321] and scanned(one) <= orcids.STRIDE
    spans = [(r["doc_id"], r["start"], r["n_tokens"]) for r in every.collect()]
    low = next(s for k, s, n in spans if k == 200) + 1
    want = sorted(x for x in spans if x[1] < low + 50 and x[1] + x[2] > low)
    some = orcids.between(spark, path, low, low + 50)
    assert sorted(tuple(r)[:3] for r in some.collect()) == want and scanned(some) <= 2 * orcids.STRIDE
    end = max(s + n for _, s, n in spans)
    assert orcids.between(spark, path, end, end + 9).count() == 0
    files = [pyarrow.orc.ORCFile(f"{path}/ids/{f}") for f in os.listdir(f"{path}/ids") if f.endswith(".orc")]
    assert all(f.row_index_stride == orcids.STRIDE for f in files)
    assert sum(f.file_length for f in files) < 1.5 * sum(n for _, _, n in spans)  # of four bytes an id each


def test_orc_stripes(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(orcids.OPTIONS, "orc.stripe.size", 200_000)
    rng = random.Random(3)
    rows = [(k, " ".join(str(rng.random()) for _ in range(300))) for k in range(600)]
    orcids.write(spark.createDataFrame(rows, "doc_id long, text string"), queries.PLACE, str(tmp_path / "x"))
    file = next(f for f in os.listdir(tmp_path / "x" / "ids") if f.endswith(".orc"))
    assert pyarrow.orc.ORCFile(tmp_path / "x" / "ids" / file).nstripes > 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        assert spark.read.orc(str(tmp_path / "x" / "ids")).rdd.getNumPartitions() > 2
        assert orcids.digests(orcids.read(spark, str(tmp_path / "x"))).count() == 600
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_orc_of_nothing(spark, tmp_path):
    path = str(tmp_path / "x")
    orcids.write(spark.createDataFrame([], "doc_id long, text string"), queries.PLACE, path)
    assert orcids.read(spark, path).count() == orcids.between(spark, path, 0, 9).count() == 0


def lloyd(points, start, rounds):
    centers = [list(c) for c in start]
    near = lambda p: min(range(len(centers)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(p, centers[k])), k))
    for _ in range(rounds):
        numbers = [near(p) for p in points]
        for k in range(len(centers)):
            own = [p for p, n in zip(points, numbers) if n == k]
            if own:
                centers[k] = [sum(x) // len(own) for x in zip(*own)]
    return centers, [(k := near(p), sum((a - b) ** 2 for a, b in zip(p, centers[k]))) for p in points]


def test_centroids(spark):
    rng = np.random.default_rng(13)
    groups = rng.normal(size=(9, 64))
    vectors = [(groups[k % 9] + rng.normal(scale=0.3, size=64)).tolist() for k in range(400)]
    vectors += [vectors[0], [0.0] * 64, [-1e-9] * 64, [1.0] * 63 + [1e6]]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [float("nan")] + [0.0] * 63, [float("inf")] + [0.0] * 63, [None] + [0.0] * 63, [3e38] * 64]
    rows = [(k, v, 0) for k, v in enumerate(vectors)] + [(900 + k, v, 0) for k, v in enumerate(odd)] + [(5, vectors[5], 0), (None, vectors[6], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")
    kept = centroids.whole(df)
    found = centroids.cluster(kept)
    own = kept.collect()
    points = [tuple(r["v"]) for r in own]
    assert sorted(r["id"] is None or r["id"] for r in own) == sorted(r[0] is None or r[0] for r in rows if r[0] is None or r[0] < 900)
    assert min(points[[r["id"] for r in own].index(402)]) == -1
    centers, want = lloyd(points, centroids.seeds(kept).tolist(), 3)
    assert found.centroids.tolist() == centers
    key = lambda x: (x[0] is None, *(v or 0 for v in x))
    got = centroids.report(found).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(((r["id"], *w) for r, w in zip(own, want)), key=key)
    assert {r["inertia"] for r in got} == {sum(d for _, d in want)}
    assert centroids.report(centroids.cluster(centroids.whole(df.where("false")))).count() == 0
    few = centroids.cluster(centroids.whole(df.where("vec_id in (1, 2)")))
    assert len(few.centroids) == 2 and {r["distance"] for r in few.rows.collect()} == {0}


@pytest.mark.parametrize("scale", [1, 3, 60, 100_000_000])
def test_bounds_lose_no_nearest(scale):
    rng = np.random.default_rng(scale)
    v = rng.integers(-scale, scale + 1, (3000, 64))
    centers = np.concatenate([v[:30], v[:5], rng.integers(-scale, scale + 1, (5, 64))])  # equal ones too
    screen = centroids.Screen(centers, 16)
    number, distance = screen.nearest(v, centroids.Compressed.of(v, 16))
    every = ((v[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_bounds_spare_distances():
    rng = np.random.default_rng(5)
    v = np.floor(64 * (w := rng.normal(size=(5000, 64))) / np.linalg.norm(w, axis=1)[:, None]).astype(np.int64)
    screen = centroids.Screen(v[:16], 16)  # no clusters at all: every centroid is about as far
    screen.nearest(v, centroids.Compressed.of(v, 16))
    assert screen.measured < 0.3 * 16 * screen.asked


@pytest.mark.parametrize("bits", [48, 12, 6])
def test_phrases_lose_no_word_to_a_hash(spark, monkeypatch, bits):
    """With hashes cut short, unlike windows stand between the copies in most rings."""
    rng = random.Random(bits)
    word = lambda: f"v{rng.randint(0, 9999)}"
    shared = [" ".join(word() for _ in range(48)) for _ in range(4)]
    rows = [(k, " ".join([*(word() for _ in range(60)), shared[k % 4], *(word() for _ in range(rng.randint(0, 60)))])) for k in range(40)]
    rows += [(40, None), (41, ""), (42, shared[0]), (None, shared[1])]
    monkeypatch.setattr(phrases, "BITS", bits)
    monkeypatch.setattr(phrases, "CHUNK", 700)
    monkeypatch.setattr(phrases, "PER_BUCKET", 8000)
    got = {r["doc_id"]: r for r in phrases.without_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r["n_removed"] for k, r in got.items()} == {k: 48 if k is None or k < 40 or k == 42 else 0 for k, _ in rows}
    assert all(got[k]["kept"] == " ".join(t.replace(shared[k % 4], " ").split()) for k, t in rows[:40])


def test_langid_in_blocks_of_languages(spark, monkeypatch):
    """A dirty column with a thousand languages is dealt to blocks, and blocks change nothing."""
    rng = random.Random(12)
    real = {"aa": "bakeli", "bb": "strückö", "cc": "ñoquión"}
    rows = [(k, " ".join(real[g][: rng.randint(2, 6)] for _ in range(20)), g) for k, g in enumerate(list(real) * 40)]
    rows += [(1000 + k, f"odd {k}", f"x{k:04d}") for k in range(1000)]
    rows += [(5000, None, "aa"), (5001, "12 !", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.blocks == -(-len(model.languages) // langid.LANGUAGES) > 1
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 4)) for r in langid.predicted(df, model).collect()}
    assert all(got[k][0] == g for k, _, g in rows[:120]) and got[5000] == got[5001] == ("und", 0.0) and len(got) == len(rows)
    monkeypatch.setattr(langid, "LANGUAGES", 5000)
    whole = langid.fit(df)
    assert whole.blocks == 1 and {r["doc_id"]: (r["lang_pred"], round(r["score"], 4)) for r in langid.predicted(df, whole).collect()} == got


# the first article of the Universal Declaration of Human Rights
PARAGRAPHS = {
    "en":"All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "de":"Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen.",
    "fr":"Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "es":"Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "it":"Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "pt":"Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "nl":"Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "cs":"Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "pl":"Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "tr":"Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "vi":"Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.",
    "fi":"Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "hu":"Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "sw":"Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
    "ru":"Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "el":"Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "ar":"يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح الإخاء.",
    "he":"כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
    "hi":"सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "zh":"人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "ja":"すべての人間は、生れながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "ko":"모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "th":"มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ",
}


def test_fertility_keeps_languages(spark):
    """Running text is kept with its language given, without it and in capitals; random letters are not."""
    rng = random.Random(1)
    rows = []
    for lang, text in PARAGRAPHS.items():
        words = text.split() if lang not in ("zh", "ja", "th") else [text[k : k + 4] for k in range(0, len(text), 4)]
        own = " ".join(words[k % len(words)] for k in rng.sample(range(4 * len(words)), 2 * len(words) + 20))
        rows += [(f"{lang} given", lang, own), (f"{lang} none", None, own), (f"{lang} capitals", lang, own.upper())]
    noise = lambda pool: " ".join("".join(rng.choice(pool) for _ in range(rng.randint(4, 9))) for _ in range(150))
    pools = ["bcdfghjklmnpqrstvwxz", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "aBcDeFgHiJkLmNoPqRsTuVwXyZ0189+/", "Ã©¢€™œab"]
    rows += [(f"noise {k}", None, noise(pool)) for k, pool in enumerate(pools)]
    df = spark.createDataFrame([(k, lang, text) for k, (_, lang, text) in enumerate(rows)] + [(None, None, None)], "doc_id long, lang string, text string")
    got = fertility.judged(fertility.measured(df, *queries.FERTILITY))
    assert got.where("doc_id is null").count() == 1
    kept = {rows[r["doc_id"]][0]: r["kept"] or r["base_failed"] for r in got.where("doc_id is not null").collect()}
    assert [k for k, v in kept.items() if v == k.startswith("noise")] == []
