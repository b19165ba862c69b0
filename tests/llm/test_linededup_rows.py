from balance_spark.llm import linededup


def test_rows_without_id(documents, rows):
    docs = documents(
        (1, "one two three"), (None, "one two three\nfour five six"), (None, "seven eight nine"),
        (None, "seven eight nine"), (None, "ten eleven twelve\nfour five six"),
    ).coalesce(1)
    left = rows(linededup.without_repeated_lines(docs), "doc_id", "text")
    assert left == sorted(
        [
            (1, "one two three"), (None, "four five six"), (None, "seven eight nine"),
            (None, "ten eleven twelve"),
        ],
        key=repr,
    )
    gone = rows(linededup.removed_lines(docs), "doc", "line", "copy")
    assert gone == sorted([(None, 0, True), (None, 0, True), (None, 1, True)], key=repr)


def test_two_texts_of_one_id(documents, rows):
    docs = documents(
        (1, "one two three"), (7, "one two three\nfour five six"), (7, "seven eight nine\nten x y"),
        (7, "seven eight nine"),
    ).coalesce(1)
    left = rows(linededup.without_repeated_lines(docs), "doc_id", "text")
    assert left == sorted(
        [(1, "one two three"), (7, "four five six"), (7, "seven eight nine\nten x y")], key=repr
    )
