import itertools

import pytest
from pyspark.sql import functions as F
from samples import COMMENTED_TEMPLATE, FILES, INVENTORY, SECTIONED_TEMPLATE, SIMPLE_TEMPLATE

from varscope.operators import reconcile, template, verdict
from varscope.operators.extract import extract
from varscope.operators.inventory import inventory, with_position


def parse(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "repo string, content string")
    out = {}
    for r in template.parse_templates(df).orderBy("repo", "ord").collect():
        out.setdefault(r.repo, []).append(r)
    return out


def test_sample_templates(spark):
    got = parse(spark, {"a": SIMPLE_TEMPLATE, "b": COMMENTED_TEMPLATE, "c": SECTIONED_TEMPLATE})
    brief = {
        repo: [(r.key, len(r.comments), r.blank_line_before) for r in rows]
        for repo, rows in got.items()
    }
    assert brief == {
        "a": [(k, 0, False) for k in ("THEME", "GIT_REF", "PAGE_SIZE", "LEGACY_FLAG")],
        "b": [("THEME", 1, False), ("GIT_REF", 2, False), ("PAGE_SIZE", 1, True)],
        "c": [
            ("RELAY_ENABLED", 1, False), ("QUEUE_DSN", 1, True), ("RETRIES", 0, False), ("REGION", 0, False),
            ("DESK_HOST", 1, True),
        ],
    }


VALUES = [
    ('COLOR="blue#green"', "COLOR", "blue#green", None),
    ("PORT=8080 # server port", "PORT", "8080", "# server port"),
    ("TOKEN=abc=def=ghi", "TOKEN", "abc=def=ghi", None),
    ("EMPTY=", "EMPTY", "", None),
    ("export URL=postgres://x", "URL", "postgres://x", None),
    ("K=#x", "K", "#x", None),
    ("K= # c", "K", "# c", None),
    ("K='a'b' # c", "K", "a'b", None),
    ('K="open', "K", "open", None),
    ('K="', "K", "", None),
    ("k_1=a\t#b  ", "k_1", "a", "#b"),
    ("  K = 1", None, None, None),
    ("1K=1", None, None, None),
    ("# K=1", None, None, None),
    ("K: 1", None, None, None),
]


def test_values(spark):
    got = parse(spark, {str(n): case[0] for n, case in enumerate(VALUES)})
    wrong = []
    for n, (line, *expected) in enumerate(VALUES):
        rows = got.get(str(n), [])
        seen = [rows[0].key, rows[0].value, rows[0].inline_comment] if rows else [None] * 3
        if seen != expected:
            wrong.append((line, seen, expected))
    assert wrong == []


def line_by_line(kinds):
    """What the format says, one line after the other: (comments, blank flag) per key."""
    entries, pending, blank, flagged = [], [], False, False
    for number, kind in enumerate(kinds):
        if kind == "b":
            blank = blank or bool(pending or entries)
            pending = []
        elif kind == "c":
            flagged = flagged or (blank and not pending)
            pending.append(f"# {number}")
        elif kind == "k":
            entries.append((pending, flagged if pending else blank))
            pending, blank, flagged = [], False, False
    return entries


def test_comments_and_blanks_of_every_short_template(spark):
    lines = {"b": " ", "c": "# {}", "k": "K=1", "o": "other"}
    sequences = [s for n in range(1, 7) for s in itertools.product("bcko", repeat=n)]
    texts = {
        "".join(s): "\n".join(lines[kind].format(i) for i, kind in enumerate(s)) + "\n"
        for s in sequences
    }
    got = parse(spark, texts)
    wrong = [
        name for name in texts
        if [(list(r.comments), r.blank_line_before) for r in got.get(name, [])] != line_by_line(name)
    ]
    assert wrong == []


def test_mixed_line_ends_and_duplicates(spark):
    rows = parse(spark, {"r": "A=1\r\n\r\n# c\r\nA=2\rB=3\x0bC=4"})["r"]
    assert [(r.ord, r.key, r.value, list(r.comments), r.blank_line_before) for r in rows] == [
        (1, "A", "1", [], False), (2, "A", "2", ["# c"], True), (3, "B", "3", [], False), (4, "C", "4", [], False),
    ]


@pytest.fixture(scope="module")
def sample(spark, files_of):
    found = inventory(with_position(extract(files_of(FILES)))).cache()

    def entries(text):
        return template.parse_templates(
            spark.createDataFrame([("r", text)], "repo string, content string")
        )

    return found, entries


def test_reconcile_sample(sample):
    found, entries = sample
    rows = reconcile.reconcile(found, entries(SIMPLE_TEMPLATE)).orderBy("pos").collect()
    known = ["THEME", "GIT_REF", "PAGE_SIZE"]
    assert [(r.key, r.status) for r in rows[:4]] == [(k, "EXISTING") for k in known] + [("LEGACY_FLAG", "STALE")]
    assert list(rows[3].comments) == ["# UNUSED (not found in codebase): LEGACY_FLAG"]
    assert rows[3].value == "0"
    new = [r for r in rows if r.status == "NEW"]
    assert [r.key for r in new] == [i[0] for i in INVENTORY if i[0] not in known]
    assert {r.key: r.value for r in new}["CACHE_PORT"] == "6380"
    assert {r.key: r.value for r in new}["REGION"] == ""


def test_join_parts_agree_with_reconcile(sample):
    found, entries = sample
    parsed = entries(SIMPLE_TEMPLATE)
    merged = reconcile.reconcile(found, parsed)
    by_status = {
        "EXISTING": reconcile.existing(parsed, found),
        "STALE": reconcile.stale(parsed, found),
        "NEW": reconcile.new(parsed, found),
    }
    columns = ["key", "value", "comments"]
    for status, part in by_status.items():
        assert sorted(map(tuple, part.select(columns).collect())) == sorted(
            map(tuple, merged.filter(F.col("status") == status).select(columns).collect())
        )


@pytest.mark.parametrize(
    ("text", "plain", "strict"),
    [
        (SIMPLE_TEMPLATE, ("fail", 1), 1),
        ("".join(f"{i[0]}=\n" for i in INVENTORY), ("pass", 0), 0),
        ("LEGACY_FLAG=\n" + "".join(f"{i[0]}=\n" for i in INVENTORY), ("pass", 0), 2),
    ],
)
def test_check(spark, sample, text, plain, strict):
    found, entries = sample
    merged = reconcile.reconcile(found, entries(text))
    stats = spark.createDataFrame([("r", 5)], "repo string, scanned_files long")
    row = verdict.check(merged, stats).first()
    assert (row.status, row.exit_code) == plain and row.scanned_files == 5
    assert verdict.check(merged, stats, strict=True).first().exit_code == strict
    assert verdict.check(merged, stats, fail_on_stale=True).first().exit_code == strict


def test_rendering(spark):
    text = "# where ships report\nHARBOUR=north\n\n# signs the log\nSIGNING_KEY=k # inline\n"
    templates = spark.createDataFrame([("r", text), ("empty", "\n# nothing\n")], "repo string, content string")
    entries = template.parse_templates(templates)
    found = spark.createDataFrame(
        [("r", n, None, (0, ["a"], 1, 0)) for n in ("HARBOUR", "SIGNING_KEY")],
        "repo string, name string, default_value string, "
        "first_pos struct<rank: bigint, parts: array<string>, line: int, column: int>",
    )
    merged = reconcile.reconcile(found, entries)
    rows = reconcile.entry_lines(merged).orderBy("pos").collect()
    assert "\n".join(r.text for r in rows) + "\n" == text
    assert {r.repo for r in rows} == {"r"}
    # Stale notices pile up run after run, everything else is stable.
    stale = reconcile.entry_lines(reconcile.reconcile(found.limit(0), entries)).orderBy("pos").collect()
    assert stale[1].text == (
        "\n# UNUSED (not found in codebase): SIGNING_KEY\n# signs the log\nSIGNING_KEY=k # inline"
    )


def test_undescribed_and_blocks(spark, sample):
    found, entries = sample
    text = "# Added by varscope\n#\nGIT_REF=1\n# real\nTHEME=1\nREGION=1\n# real\nREGION=2\nGONE=1\n"
    rows = reconcile.undescribed(found, entries(text)).collect()
    existing = {r.name for r in rows if r.existing}
    assert existing == {"GIT_REF", "REGION"}
    assert {r.name for r in rows} == {i[0] for i in INVENTORY} - {"THEME"}
    block = spark.createDataFrame([("d", "e"), ("d", "")], ["d", "e"]).select(
        reconcile.description_block(F.col("d"), F.col("e"))
    )
    assert [list(r[0]) for r in block.collect()] == [
        ["# Added by varscope", "#", "# Description: d", "# Example:     e", "#"],
        ["# Added by varscope", "#", "# Description: d", "#"],
    ]
