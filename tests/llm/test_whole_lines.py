"""Line dedup against an independent brute force over shingles from every place."""

from tidemark.llm import lines

LINES = [
    "see https://example.org/a/1 for details",
    "see https://example.org/b/7 for details",
    "contact christopher-jones@x.org now",
    "contact christopher-smith@y.net now",
    "qwertyuiopasdfgh zxcvbnmasdfghjk",  # 32 and 33 characters: on both sides of 16 a word
    "qwertyuiopasdfgh zxcvbnmasdfghjkl",
    "日本語のとても長い行です甲",
    "日本語のとても長い行です乙丙丁",
    "https://example.org/one/very/long/path/that/ends/with/the/same/words/but/here/page1",
    "https://example.org/one/very/long/path/that/ends/with/the/same/words/but/here/page12",
]


def grams(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def alike(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_every_place_counts(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.deduplicate_lines(df).collect()}
    want = {i: "" if any(alike(x, LINES[j]) >= 0.8 for j in range(i)) else x for i, x in enumerate(LINES)}
    assert [i for i, x in want.items() if not x] == [5, 9]
    assert got == want


def test_similarity_is_exact(spark):
    rows = [(a, b) for a in LINES for b in LINES]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", lines.jaccard(lines.shingles(df["a"]), lines.shingles(df["b"])).alias("j")).collect()
    assert all(abs(r["j"] - alike(r["a"], r["b"])) < 1e-12 for r in got)


def test_no_limit_by_length_of_words(spark):
    base = "abcdefghijklmnop qrstuvwxyzabcdef"  # words of 16 characters, and one more and one less
    rows = [(1, base[:-1]), (2, base), (3, base + "g"), (4, base + "gh")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.deduplicate_lines(df).collect()} == {1: base[:-1], 2: "", 3: "", 4: ""}


def test_a_text_of_very_many_lines(spark):
    """Removal is linear in a text's lines: 100,000 of them, most repeated, in seconds; and a line of a MB beside them."""
    import time

    many = "\n".join(f"line number {i % 500} of the log that goes on and on" if i % 3 else f"{i * 7919}" for i in range(100_000))
    long_ = " ".join(f"w{i * 31 % 9973}" for i in range(150_000))
    df = spark.createDataFrame([(1, many), (2, long_), (3, long_ + "\nshort")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in lines.deduplicate_lines(df, count_as="n").collect()}
    assert time.time() - began < 90
    left = got[1]["text"].split("\n")
    assert len(left) + got[1]["n"] == 100_000 and len(set(left)) == len(left) and left[:3] == many.split("\n")[:3]
    assert left == [x for x in dict.fromkeys(many.split("\n")) if x in set(left)]
    assert got[2]["text"] == long_ and got[3]["text"] == "short"
