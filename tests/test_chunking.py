import pytest

from corpusquery.operators.chunking import chunk


def texts(spark, text, **options):
    docs = spark.createDataFrame([("d", text)], "source string, text string")
    return [r.text for r in chunk(docs, **options).orderBy("chunk_index").collect()]


def by_hand(text, size, overlap):
    out = []
    for p in filter(None, (p.strip() for p in text.strip().split("\n\n"))):
        if len(p) <= size:
            out.append(p)
            continue
        start = 0
        while True:
            piece = p[start : start + size].strip()
            out += [piece] if piece else []
            if start + size >= len(p):
                break
            start += size - overlap
    return out


def test_short_paragraphs_stay_whole(spark):
    assert texts(spark, "One short line.\n\nAnother one.", size=100, overlap=10) == ["One short line.", "Another one."]


def test_windows(spark):
    got = texts(spark, "x" * 50, size=20, overlap=5)
    assert [len(t) for t in got] == [20, 20, 20]


def test_blank_and_null(spark):
    assert texts(spark, " \n\n ") == [] == texts(spark, None)


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        texts(spark, "x", size=10, overlap=10)


@pytest.mark.parametrize("n", [1, 19, 20, 21, 35, 36, 51, 200])
def test_windows_as_by_hand(spark, n):
    text = "\n\n".join([("é b" * n)[:n], " ", "tail " * 9])
    assert texts(spark, text, size=20, overlap=5) == by_hand(text, 20, 5)


def test_assignments(spark):
    text = 'A1 = "first value"\nA2 = ""\nA3 = \'odd"\ndocuments = [\nplain line\nB = "open'
    assert texts(spark, text, assignments=True) == ["first value", "", "odd", "plain line", 'B = "open']
    assert texts(spark, "plain\nlines", assignments=True) == ["plain\nlines"]


def test_ids_and_metadata(spark):
    docs = spark.createDataFrame([("d", "a\n\nb", {"lang": "en", "source": "x"})], "source string, text string, extra map<string,string>")
    rows = chunk(docs, extra="extra").orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.source, r.char_length, r.extra) for r in rows] == [("d#chunk-0000", "d", 1, {"lang": "en"}), ("d#chunk-0001", "d", 1, {"lang": "en"})]


def test_id_beyond_four_digits(spark):
    docs = spark.createDataFrame([("d", "\n\n".join(["a"] * 10001))], "source string, text string")
    assert chunk(docs).orderBy("chunk_index").tail(1)[0].chunk_id == "d#chunk-10000"


def test_generator_is_not_evaluated_twice(spark, capsys):
    chunk(spark.createDataFrame([("d", "a")], "source string, text string")).explain()
    plan = capsys.readouterr().out
    assert "Generate posexplode" in plan and "size(" not in plan
