import re
import time
from dataclasses import replace

import pytest
from samples import COLUMNS, FILES, INVENTORY, N_LOCATIONS

from varscope.operators.extract import extract, file_names
from varscope.operators.inventory import file_findings, inventory, with_position
from varscope.operators.languages import DOCKER, JAVASCRIPT, PYTHON, LineLanguage
from varscope.plans.queries import MAKE, RUBY, SETTINGS

@pytest.fixture(scope="module")
def sample_refs(spark, files_of):
    return with_position(extract(files_of(FILES))).cache()


def test_whole_inventory(sample_refs):
    places = {}
    for r in sorted(sample_refs.collect(), key=lambda r: (r.path, r.line, r.column)):
        places.setdefault(r.name, []).append(f"{r.path}:{r.line}")
    rows = sorted(inventory(sample_refs).collect(), key=lambda r: r.first_pos)
    got = [
        (r.name, r.inferred_type, r.is_required, r.default_value, r.language,
         " ".join(places[r.name]))
        for r in rows
    ]
    assert got == INVENTORY
    assert sum(r.n_locations for r in rows) == N_LOCATIONS


def test_byte_columns(sample_refs):
    got = {(r.path, r.name): r.column for r in sample_refs.collect()}
    assert {k: got[k] for k in COLUMNS} == COLUMNS


def found(spark, files_of, path, text):
    rows = extract(files_of({path: text})).collect()
    return [
        (r.name, r.line, r.column, r.default_value, r.is_required)
        for r in sorted(rows, key=lambda r: (r.line, r.column, r.name))
    ]


def failures(files_of, name, cases, pick):
    """Cases whose references differ, all extracted by one job."""
    files = files_of({f"{n}/{name}": text for n, (text, _) in enumerate(cases)})
    got = {n: [] for n in range(len(cases))}
    for r in extract(files).orderBy("path", "line", "column", "name").collect():
        got[int(r.path.split("/")[0])].append(pick(r))
    return [
        (text, got[n], expected) for n, (text, expected) in enumerate(cases) if got[n] != expected
    ]


PYTHON_CASES = [
    ('os.getenv("A", os.getenv("B"))', [("A", 1, 0, None, False), ("B", 1, 15, None, True)]),
    ('my.os.getenv("N")', []),
    ('os.getenv("X", None)', [("X", 1, 0, None, False)]),
    ('os.getenv("X", "")', [("X", 1, 0, None, False)]),
    ('os.getenv("X", 8080)', [("X", 1, 0, None, False)]),
    ('os.getenv("X", default="d")', [("X", 1, 0, None, False)]),
    ('os.getenv("X",)', [("X", 1, 0, None, True)]),
    ('os.getenv(key="X")', []),
    ('os.getenv("X" + y)', []),
    ('os.getenv("X" "Y")', []),
    ('os.getenv(("X"))', []),
    ('os.getenv("")', []),
    ("os.getenv( # why\n  'X', # and\n  'd' # so\n)", [("X", 1, 0, "d", False)]),
    ('os.getenv("""X""", """a\nb""")\nos.environ["Y"] = 1', [("X", 1, 0, "a\nb", False), ("Y", 3, 0, None, True)]),
    ('del os.environ["X"]', [("X", 1, 4, None, True)]),
    ('f"é{os.getenv(\'X\', \'d\')} {{os.getenv(\'NO\')}}"', [("X", 1, 5, "d", False)]),
    ('f"os.getenv(\'NO\')"', []),
    ('rf"{os.environ[\'X\']}"', [("X", 1, 4, None, True)]),
    ('f"""\n{os.getenv(\'X\')}"""', [("X", 2, 1, None, True)]),
    ('f"{ {\'a\': os.getenv(\'X\')} }"', [("X", 1, 10, None, True)]),
    ('os.getenv(f"PRE_{x}")', [("PRE_", 1, 0, None, True)]),
    ('os.getenv("X", f"a{os.getenv(\'Y\')}")', [("X", 1, 0, "a", False), ("Y", 1, 19, None, True)]),
    ("'''\nos.getenv('NO')\n'''", []),
    ("s = 'it\\'s os.getenv(\"NO\")'\nos.getenv('X')", [("X", 2, 0, None, True)]),
    ('os.environ.get("X").replace(os.environ["Y"])', [("X", 1, 0, None, True), ("Y", 1, 28, None, True)]),
    ("", []),
    ("\x00\x01\x02", []),
    ("a = '\x01' + os.getenv('X')\n", [("X", 1, 10, None, True)]),
    ("f\"{{{os.getenv('X')}}}\"", [("X", 1, 5, None, True)]),
    ("f'{f(\"}\") + os.getenv(\"X\")}'", [("X", 1, 12, None, True)]),
    ('f"{d["k"]} {os.getenv("X")}"', [("X", 1, 12, None, True)]),
    ('f"' + "{f'" * 1 + '{f"{f\'{f"{f\'{f"{os.getenv("X")}"}\'}"}\'}"}' + "'}" + '"', [("X", 1, 21, None, True)]),
    ("f\"{x:'>10} {os.getenv('X', 'd'):{w}} {y!r:#>9}\" + os.getenv('Y')", [("X", 1, 12, "d", False), ("Y", 1, 50, None, True)]),
    ("f'{x:os.getenv(1)} {{os.getenv(\"NO\")}} {[os.getenv(\"X\")][0]:>{os.getenv(\"W\")}}'", [("X", 1, 41, None, True), ("W", 1, 62, None, True)]),
    ("b\"os.getenv('NO')\"; rb'\\'os.getenv(\"NO\")'; f'a' + os.getenv('X')", [("X", 1, 50, None, True)]),
    ("f'unclosed {\nos.getenv('X')", [("X", 2, 0, None, True)]),
    ("f\'\'\'{\nx # }\n}{os.getenv('X')}\'\'\'", [("X", 3, 2, None, True)]),
]


def test_python(files_of):
    assert failures(
        files_of, "a.py", PYTHON_CASES,
        lambda r: (r.name, r.line, r.column, r.default_value, r.is_required),
    ) == []


JS_CASES = [
    ("[...process.env.A.split(',')]", [("A", 4)]),
    ("x.process.env.NO; $process.env.NO", []),
    ('process?.env?.A + process?.env["B"]', [("A", 0), ("B", 18)]),
    ('process.env?.["NO"]', []),
    ("process.env.a; process.env.B.C", [("a", 0), ("B", 15)]),
    ('process.env["A" + x]; process.env[`B`]; process.env[c]', []),
    ("`${process.env.A} process.env.NO \\${process.env.NO}`", [("A", 3)]),
    ("`${ {a: {b: process.env['A']}} }`", [("A", 12)]),
    ("`${x ? `y${process.env.A}` : ''}` + process.env.B", [("A", 11), ("B", 36)]),
    ("/* process.env.NO\n*/ '\\' process.env.NO'", []),
    ("const {A} = process.env;", []),
    ("`a${f(() => { if (a) { g({ k: { v: process.env.A } }) } })}`", [("A", 35)]),
    ("`a${f('}') + process.env.A}`", [("A", 13)]),
    ("`a${ `process.env.NO` }`; process.env.A", [("A", 26)]),
    ("`${`${`${process.env.A} ${process.env.B}`}`}` + process.env.C", [("A", 9), ("B", 26), ("C", 48)]),
    ("p.replace(/\\/*$/, '')\nprocess.env.A", [("A", 0)]),
    ("x = /[/*]/\nprocess.env.A", [("A", 0)]),
    ("s.split(/`/); process.env.A", [("A", 14)]),
    ('x.match(/"/g) || process.env.A', [("A", 17)]),
    ("u = /https?:\\/\\//; process.env.A", [("A", 19)]),
    ("a = b / c / process.env.A / 'x'", [("A", 12)]),
    ("return /'/.test(process.env.A)", [("A", 16)]),
    ("<p>Don't {process.env.A} won't</p>", [("A", 10)]),
    ("<p>http://x {process.env.A}</p>", [("A", 13)]),
    ("<p>src/*.js ` {process.env.A}</p>", [("A", 15)]),
    ("`http://${process.env.A}/it's` + process.env.B", [("A", 10), ("B", 33)]),
    ("case'process.env.NO': x = 'open\nprocess.env.A", [("A", 0)]),
    ("// it's\nprocess.env.A /* ' */ + process.env.B // process.env.NO", [("A", 0), ("B", 24)]),
    ("let z = i++ / 2, c = process.env.A / 3;", [("A", 21)]),
    ("x = a-- / 2; y = process.env.Q; z = 1 / 2;", [("Q", 17)]),
    ("if (x) /'/.test(y); const a = process.env.A; const s='k';", [("A", 30)]),
    ("while (f(a) / 2 > 1) /'/.test(process.env.A)", [("A", 30)]),
    ("f(a) / 2 / process.env.B / 'x'", [("B", 11)]),
    ("const f = (x) => { g(x) }\n/'/.test(process.env.A)", [("A", 9)]),
    ("const o = ({a: 1} / 2 / process.env.A / '1')", [("A", 24)]),
    ("const e = <p>use process.env.NO</p>;", []),
    ("return (<A b={process.env.A} c='process.env.NO' d=\"x/y\"><B/>it's {`q${process.env.B}`} <C d={() => <D/>}>don't</C></A>) / 2; process.env.C",
     [("A", 14), ("B", 70), ("C", 125)]),
    ("const e = <>it's <b/> process.env.NO {process.env.A}</>; process.env.B", [("A", 38), ("B", 57)]),
    ("s.replace(/>/g, '&gt;').replace(/</g, '&lt;') + process.env.A", [("A", 48)]),
    ("const f = <T,>(x: T) => process.env.A; const g = a < b; const h = process.env.B > 3 / 2;", [("A", 24), ("B", 66)]),
    ("const f = <T extends X>(x: T) => process.env.A; const g = <T>x; h = <b/>; process.env.B", [("A", 33), ("B", 74)]),
]


def test_javascript(files_of):
    assert failures(files_of, "a.tsx", JS_CASES, lambda r: (r.name, r.column)) == []


def test_go(spark, files_of):
    text = (
        'x := `os.Getenv("NO")` + "os.Getenv(NO)" // os.Getenv("NO")\n'
        'a, b := os.LookupEnv("A"), os.Getenv("B" /* c */)\n'
        'os.Getenv(`NO`); os.Getenv(/* c */ "NO"); my.os.Getenv("NO"); r := \'"\'; os.Getenv("C")'
    )
    assert [(r[0], r[1], r[2]) for r in found(spark, files_of, "a.go", text)] == [
        ("A", 2, 8), ("B", 2, 27), ("C", 3, 72),
    ]


SHELL_CASES = [
    ("echo ${Foo}", [("F", 1)]),
    ("echo $Foo", []),
    ("echo ${A:-${B}}", [("A", 1)]),
    ("export X=1", []),
    ("X=1\necho $X", []),
    ("X=1\nexport X\necho $X", [("X", 3)]),
    ("X=1\nexport A X\necho $X", []),
    ("local X=1\necho $X", [("X", 2)]),
    ("X=$X # own\nY=${Y:-1}", [("X", 1), ("Y", 2)]),
    ("X=1 # $X", []),
    ("echo ${#ARR} $_ $$ $1", [("ARR", 1)]),
    ("echo $B $A ${B}", [("A", 1), ("B", 1)]),
    ("a\rb\x0becho $X echo $Y", [("X", 3), ("Y", 4)]),
]


def test_shell(files_of):
    assert failures(files_of, "a.zsh", SHELL_CASES, lambda r: (r.name, r.line)) == []


DOCKER_CASES = [
    ("ENV A=1 B=2", [("A", 1, 0, "1 B=2", False)]),
    ("ENV F=", [("F", 1, 0, None, True)]),
    ('ENV F=""', [("F", 1, 0, "", False)]),
    ("ENV F  ", [("F", 1, 0, None, True)]),
    ("ARG F=", [("F", 1, 0, "", False)]),
    ("ARG F", [("F", 1, 0, None, True)]),
    ("ARG F b\nARG F=c", [("F", 2, 0, "c", False)]),
    ("  ENV A 'x'  ", [("A", 1, 0, "x", False)]),
    ("ENV A=\"'x'\"", [("A", 1, 0, "'x'", False)]),
    ("ENV Ab=1\nenv B=1\nARG c=1", []),
    ("ENV A=1\nARG A=2\nARG B=3", [("A", 1, 0, "1", False), ("B", 3, 0, "3", False)]),
    ("ENV A =x", [("A", 1, 0, "=x", False)]),
]


def test_docker(files_of):
    assert failures(
        files_of, "Dockerfile.py", DOCKER_CASES,
        lambda r: (r.name, r.line, r.column, r.default_value, r.is_required),
    ) == []


def test_registered_language(spark, files_of):
    text = "# ENV['NO']\na = ENV['A'] + ENV.fetch(\"B\", 'b') + \"ENV['NO']\"\n"
    rows = extract(files_of({"a.rb": text}), (RUBY,)).orderBy("column").collect()
    assert [(r.language, r.name, r.column, r.default_value) for r in rows] == [
        ("ruby", "A", 4, None), ("ruby", "B", 15, "b"),
    ]


def test_long_literals_neither_overflow_nor_hide_code(spark, files_of):
    texts = {
        "a.py": '"' + '\\"x' * 200_000 + '"; os.getenv("A")',
        "b.py": '"""' + 'a"b' * 100_000 + '"""\nos.getenv("B")',
        "c.js": "`" + "${a}" * 50_000 + "${process.env.C}`",
        "d.js": "/*" + "*" * 300_000 + "*/ process.env.D",
        "e.py": "#" * 300_000 + "\n" + "os.getenv('E')\n" * 2_000,
    }
    rows = extract(files_of(texts)).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in rows} == {"A": 1, "B": 1, "C": 1, "D": 1, "E": 2000}


def test_file_findings_keep_source_order(spark, files_of):
    text = 'os.environ["A"]\nos.getenv("B", "x")\nos.getenv("A", "first") + os.getenv("A", "second")'
    rows = {r.name: r for r in file_findings(extract(files_of({"a.py": text}))).collect()}
    assert [(p.line, p.column) for p in rows["A"].locations] == [(1, 0), (3, 0), (3, 26)]
    assert (rows["A"].is_required, rows["A"].default_value) == (True, "first")
    assert (rows["B"].is_required, rows["B"].default_value) == (False, "x")


@pytest.mark.parametrize(
    ("text", "expected"),
    [("ARG X=", ""), ("ENV X=", None)],
)
def test_default_fold_takes_last_when_none_is_set(spark, files_of, text, expected):
    # `a/b.py` comes before `a.py`: components, not characters, are compared.
    files = files_of({"a/b.py": 'os.environ["X"]', "a-b/Dockerfile": "ENV X=", "a0/Dockerfile": text})
    assert inventory(extract(files)).first().default_value == expected


def test_result_does_not_depend_on_partitioning(spark, files_of):
    refs = with_position(extract(files_of(FILES)))
    one = {r.name: r for r in inventory(refs.coalesce(1)).collect()}
    many = {r.name: r for r in inventory(refs.repartition(13)).collect()}
    assert one == many


def test_many_references_on_one_line(spark, files_of):
    n = 1500
    text = ";".join(f"é(process.env.V{k})" for k in range(n))
    rows = extract(files_of({"a.js": text})).select("name", "line", "column").collect()
    data, at, want = text.encode(), 0, []
    for k in range(n):
        at = data.index(b"process.env", at)
        want.append((f"V{k}", 1, at))
        at += 1
    assert sorted(map(tuple, rows), key=lambda r: r[2]) == want


def test_both_ways_of_reading_agree(spark, files_of):
    """A text read by the plain pattern gives the same rows if it is read by the stack."""
    for name, cases, language, trap in (
        ("a.py", [t for t, _ in PYTHON_CASES], PYTHON, "\nx = f'{y}'"),
        ("a.js", [t for t, _ in JS_CASES], JAVASCRIPT, "\n;`${y}`;"),
    ):
        plain = [t for t in cases if not re.search(language.trap.replace("(?<!\\w)", ""), t)]
        assert len(plain) >= 5
        for texts in (plain, [t + trap for t in plain]):
            rows = extract(files_of({f"{n}/{name}": t for n, t in enumerate(texts)})).collect()
            got = {(r.path, r.name, r.line, r.column, r.default_value, r.is_required) for r in rows}
            first = got if texts is plain else first
            assert got == first and len(got) >= 5


def test_a_line_is_held_once(spark, files_of):
    """The cost of a line grows with its references, not with their square."""
    seconds = {}
    for n in (4000, 4000, 32_000):
        files = files_of({"a.js": ";".join(f"g(process.env.A{k})" for k in range(n))})
        start = time.perf_counter()
        rows = extract(files).select("name", "line", "column").distinct().count()
        seconds[n] = time.perf_counter() - start
        assert rows == n
    assert seconds[32_000] < 9 * seconds[4000] + 5


def test_names_of_a_file_come_once(spark, files_of):
    rows = file_names(files_of(FILES)).collect()
    assert len(rows) == len({(r.path, r.name) for r in rows})
    assert {(r.path, r.name) for r in rows} == {(r.path, r.name) for r in extract(files_of(FILES)).collect()}


def test_own_line_language(files_of):
    own = replace(DOCKER, name="compose", extensions=(".env",), filename_prefixes=("Containerfile",))
    rows = extract(files_of({"Containerfile.x": "ENV A=1\nARG B\n", "x.env": "ARG C=2"}), (own,)).collect()
    assert sorted((r.name, r.language, r.default_value) for r in rows) == [
        ("A", "compose", "1"), ("B", "compose", None), ("C", "compose", "2"),
    ]
    with pytest.raises(ValueError):
        LineLanguage("x", (".x",), ("X",))


def test_line_language_by_grammar_alone(files_of):
    text = "A ?= 1\nB = $(C) $(A) $(shell x) $@\nuse:\n\techo $(B) ${D} $(MAKE)\n"
    rows = extract(files_of({"Makefile": text, "x.mk": "X = $(Y)"}), (MAKE,)).collect()
    assert sorted((r.path, r.name, r.line) for r in rows) == [("Makefile", "C", 2), ("Makefile", "D", 4), ("x.mk", "Y", 1)]
    service = replace(SETTINGS, extensions=(".service",), filename_prefixes=())
    lines = "[Service]\nEnvironment=A=1\n Environment = B =\nEnvironment=A=2\nPassEnvironment=C\n"
    rows = extract(files_of({"x.service": lines}), (service,)).collect()
    assert sorted((r.name, r.line, r.default_value, r.is_required) for r in rows) == [
        ("A", 2, "1", False), ("B", 3, "", False), ("C", 5, None, True),
    ]
