import datetime as dt

from spotcheck.sources.words import certificate_words, lines_of_words

SCHEMA = "file string, page int, x0 double, x1 double, y double, word string"


def line(y, *words, file="f", page=1):
    return [(file, page, float(x), float(x + 5 * len(w)), float(y), w) for x, w in words]


def read(spark, rows):
    return [tuple(r)[2:] for r in certificate_words(spark.createDataFrame(rows, SCHEMA)).orderBy("file", "record").collect()]


def test_a_record_of_two_lines(spark):
    rows = line(10, (0, "Channel:")) + line(20, (0, "01/02/2025"), (60, "Late"), (82, "News"), (150, "Theme"), (177, "AB"), (200, "20:30:00:05"), (260, "00:00:30")) + line(30, (150, "more")) + line(40, (0, "x"))
    assert read(spark, rows) == [(dt.date(2025, 2, 1), "Late News", "20:30:00", "Theme AB more", 30)]


def test_lines_hang_on_their_first_word(spark):
    ys = [10.0, 12.9, 13.0, 13.1, 15.9, 16.0, 16.2, 30.0]
    rows = [("f", 1, 0.0, 5.0, y, "w") for y in ys] + [("f", 2, 0.0, 5.0, 12.0, "w")]
    got = {(r["page"], r["y"]): r["line"] for r in lines_of_words(spark.createDataFrame(rows, SCHEMA)).collect()}
    want, begin = {}, None
    for y in ys:
        begin = y if begin is None or round(y - begin, 1) > 3 else begin
        want[1, y] = begin
    assert got == want | {(2, 12.0): 12.0}  # a chain of small steps is no single line


def test_durations_dates_and_noise(spark):
    rows = line(10, (0, "13/01/25"), (60, "Morning"), (200, "Soap"), (300, "15"), (330, "07:00:00"))  # a number before the time; day first
    rows += line(30, (0, "02-03-2025"), (60, "Evening"), (110, "Show"), (300, "Tea"), (400, "19:00:00"), (470, "45")) + line(45, (0, "12"), (60, "Fri"), (90, "CB 2"), (120, "1,200.50"), (200, "123456"), (300, "Gold45"))
    rows += line(60, (0, "05/06/2025"), (60, "Midday"))  # no time
    rows += line(80, (0, "99/99/2025"), (60, "Midday"), (200, "10:00:00"))  # no date
    rows += line(100, (0, "07/08/2025"), (60, "Drama - Milk"), (200, "22:00:00"), (250, "00:00:20"))  # one column
    rows += line(120, (0, "Page 1 of 2")) + line(130, (0, "Rs : 500")) + line(140, (0, "....."))
    rows += [("f", 2, 60.0, 90.0, 5.0, "extra"), ("f", 2, 0.0, 1.0, 9.0, None), ("g", 1, 0.0, 1.0, 9.0, "alone")]
    got = read(spark, rows)
    assert got[0] == (dt.date(2025, 1, 13), "Morning", "07:00:00", "Soap", 15)
    assert got[1] == (dt.date(2025, 3, 2), "Evening Show", "19:00:00", "Tea Gold", 45)
    assert got[2] == (dt.date(2025, 8, 7), "Drama extra", "22:00:00", "Milk", 20) and len(got) == 3


def test_no_words(spark):
    assert read(spark, []) == []
