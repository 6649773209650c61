from pyspark.sql import functions as F

from scoria.llm import truncation

NAMES = ["brilo", "kafan", "tosuri", "velim", "norapa", "sudelo", "mirtan", "polvis"]


def rows():
    """Sentences of two patterns, whole and cut; endings without a mark; an ending that is a beginning elsewhere."""
    out, seq = [], 0

    def add(text, cut, source="A", field="description"):
        nonlocal seq
        seq += 1
        arrays = {"description": None, "solution": None, "impact": None, field: text if isinstance(text, list) else [text]}
        out.append((seq, source, arrays["description"], arrays["solution"], arrays["impact"], cut, field))

    for i, n in enumerate(NAMES * 5):
        whole = f"Successful use lets a peer read {i + 3} rows of {n} or change /{n}/x{i}.cfg. The service {n} keeps the state at port {i + 80} and stops at once."
        add(whole, False)
        add(f"Upgrade {n.capitalize()} Server to {i}.{i + 1}.2 or later, then restart the whole service {n} again.", False, field="solution")
        add(f"Upgrade {n.capitalize()} Server to {i}.{i + 1}.2 or later", False, field="solution")
        add([whole, f"Affected build: {n.capitalize()} Server {i}.{i}.1"], False)
    for i, end in enumerate(["lets a pe", "lets a peer", "read 7 rows of", "The service velim keeps the st", "keeps the state at", "stops at o"]):
        whole = f"Successful use lets a peer read 7 rows of velim or change /velim/y{i}.cfg. The service velim keeps the state at port 9 and stops at once."
        add(whole[: whole.index(end) + len(end)], True, "B")
    add("Successful use lets a peer re...", True, "B")
    for text in ("None", "None", "N/A", ""):
        add(text, False, "C")
    return out


def frame(spark):
    return spark.createDataFrame(rows(), "seq bigint, source string, description array<string>, solution array<string>, impact array<string>, text boolean, salt string")


def test_finds_cuts_and_nothing_else(spark):
    got = {(r.id, r.field) for r in truncation.truncated_values(frame(spark)).collect()}
    assert got == {(r[0], r[6]) for r in rows() if r[5]}


def test_one_text_for_a_third_of_the_rows(spark):
    """Copies of one cut text make no ending, of a trigram or a pair, and copies of one whole text don't turn it into a cut."""
    base = rows()
    cut = [f"Successful use lets a peer read 7 rows of {n} or change /{n}/z.cfg. The service {n} keeps the state at" for n in NAMES[:4]]
    paired = "Every other node reads some rows of"
    for hot, is_cut in ((cut[0], True), (paired, True), ("Upgrade Velim Server to 7.8.2 or later", False)):
        texts = [hot] * (len(base) // 2) + cut[1:]
        more = [(1000 + i, "D", [x], None, None, is_cut if x == hot else True, "description") for i, x in enumerate(texts)]
        data = spark.createDataFrame(base + more, frame(spark).schema)
        got = {(r.id, r.field) for r in truncation.truncated_values(data).collect()}
        assert got == {(r[0], r[6]) for r in base + more if r[5]}


def test_white_space_after_a_cut(spark):
    """A cut text may end with line ends or other white space; the last blank elements of a field don't count."""
    ends = [" ", "\n", "\t", "\r\n", "\xa0", "\n\n "]
    cut = "Successful use lets a peer read 7 rows of velim or change /velim/q.cfg. The service velim keeps the state at"
    more = [(2000 + i, "D", [cut + e, e], None, None, True, "description") for i, e in enumerate(ends)] + [(2100 + i, "D", [cut + " port 9 and stops at once." + e], None, None, False, "description") for i, e in enumerate(ends)]
    got = {(r.id, r.field) for r in truncation.truncated_values(spark.createDataFrame(rows() + more, frame(spark).schema)).collect()}
    assert got == {(r[0], r[6]) for r in rows() + more if r[5]}


def test_cut_in_a_code(spark):
    """The beginning of a code in capitals, before its digits, is a cut, although names end sentences elsewhere."""
    whole = [(i, "A", [f"The cache trusts it. This is tracked as ZVA-{100 + i}-{i}; see the notes of {n}."], None, None, False, "description") for i, n in enumerate(NAMES * 9)]
    cut = [(500 + i, "A", [f"The cache trusts it. This is tracked as {c}"], None, None, True, "description") for i, c in enumerate(["Z", "ZV", "ZVA", "ZVA-"] * 2)]
    got = {r.id for r in truncation.truncated_values(spark.createDataFrame(whole + cut, frame(spark).schema)).collect()}
    assert got == {r[0] for r in cut}


def test_rates(spark):
    got = {(r.source, r.field): (r.texts, r.cut) for r in truncation.truncation_rates(frame(spark)).collect()}
    assert got[("B", "description")] == (7, 7) and got[("A", "description")][1] == 0 and got[("C", "description")] == (3, 0)


def test_edges(spark):
    schema = "seq bigint, source string, description array<string>, solution array<string>, impact array<string>"
    edge = spark.createDataFrame([(1, None, None, [], [None, " "]), (2, "s", [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(15000))], None, None), (3, "s", ["\n"], ["…"], ["-"])], schema)
    blanks = ["\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", " \t\r\n ", "\t\t", "", "x" * 100_000, "é" * 40_000 + "9", "again " * 30_000, "..."]
    edge = edge.unionByName(spark.createDataFrame([(10 + i, "t", [b], [b, b], None) for i, b in enumerate(blanks)], schema))
    assert truncation.truncated_values(edge).count() == 0 and truncation.truncated_values(edge.limit(0)).count() == 0
    assert truncation.truncation_rates(edge.withColumn("cut", F.lit(1))).count() >= 1
