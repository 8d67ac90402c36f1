from loomgraph.llm import handwritten


def test_notice_after_a_long_licence_header():
    lines = "".join(f"// Licence line {i}\n" for i in range(30))
    assert handwritten.head_notice(lines + "// Vendored from x 1.2\nx = 1\n")[0] == "vendored"
    block = "/*\n" + "".join(f"Licence line {i}\n" for i in range(30)) + "Copied from elsewhere\n*/\n"
    kind, at = handwritten.head_notice(block + "x = 1;\n// Code generated by y\n")
    assert kind == "vendored" and at == len(block)


def test_source_map_in_the_last_line():
    text = "var a=1;\n//# sourceMappingURL=a.js.map\n"
    assert handwritten.tail_notice(text) == ("minified", 9)
    assert handwritten.tail_notice(text + "var b = 2;\n")[0] == ""


def test_source_map_counts_in_describe(spark):
    rows = [(1, "a/b.js", "var a=1;\n//# sourceMappingURL=a.js.map"), (2, "a/c.js", "var a = 1;\n")]
    out = {r["doc_id"]: r["notice"] for r in handwritten.describe(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert out == {1: "minified", 2: ""}


def test_long_lines_of_literals_count_whole():
    row = "1, " * 10_000
    assert handwritten.literal_share(["x = ["] + [row] * 4 + ["]"]) > 0.99
    assert handwritten.literal_share([row + " f(x)"] * 4) == 0.0
    assert handwritten.literal_share(["1" * 60 + "x"] * 4) == 0.0
