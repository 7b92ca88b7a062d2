"""Symbols and calls of brace languages against what a reader finds in the sources."""

TS = '''import { x } from "./x";
// class Fake { run() { no(); } }
/* function hidden() { no(); } */
function greet(name: string): string {
    return `Hello, ${name}! {`;
}

export async function load<T>(id: string): Promise<T> {
    const response = await fetch(`/api/${id}`);
    if (!response.ok) {
        throw new Error("bad ) }");
    }
    return response.json<T>();
}

interface User { id: string; act(): void; }

class Auth extends Base {
    private key = "}{";
    private made = make();

    constructor(base: string) {
        super(base);
        this.base = base;
    }

    async login(email: string, body: { a: number }): Promise<string> {
        const r = /[/"(]+/.test(email) ? read(email) : this.login(email, body);
        items.forEach((item) => {
            keep(item);
        });
        function inner() { deep(); }
        return r;
    }
}

top();
'''

JAVA = '''package a.b;

import java.util.List;

public class Store<T extends Item> implements Base {
    private final List<T> items = load();

    public Store(int size) {
        this.size = size;
        init(size);
    }

    @Override
    @Named("x{")
    public <R> List<R> find(String key, int n) throws IOException, Odd {
        for (T item : items) {
            if (item.matches(key)) { out.add(new Entry(item, '{')); }
        }
        String s = """
            text { call( """;
        return Lists.<R>copy(out);
    }

    abstract void later(int x);

    interface Part {
        int size();
    }
}
'''

GO = '''package main

import "fmt"

type Store struct {
	items map[string]interface{}
}

func (s *Store) Get(key string) (interface{}, error) {
	v, ok := s.items[key]
	if !ok {
		return nil, fmt.Errorf(`no { "%s"`, key)
	}
	return clean(v), nil
}

func Map[T any](in []T, f func(T) T) []T {
	go func() { run(in) }()
	return append(in[:0], f(in[0]))
}

func main() { fmt.Println(len("{")) }
'''

DART = """import 'dart:async';

class Auth extends Base {
  final String key = make('}');
  Auth(this.name) : super(name);

  factory Auth.of(Map j) => Auth(j['n']);

  Future<void> login(String a,
      String b) async {
    final r = await send(a, '''{ x( ''');
    print('done $r {');
  }

  int size() => items.count();
}

void main() {
  final a = Auth('x');
  run(a);
}
"""


def frames(spark, rows):
    from loomgraph.sources import lexer

    symbols, calls = lexer.symbols_and_calls(spark.createDataFrame(rows, "path string, language string, content string"))
    return {tuple(r) for r in symbols.collect()}, {tuple(r) for r in calls.collect()}


def test_typescript(spark):
    symbols, calls = frames(spark, [("a.ts", "typescript", TS)])
    assert symbols == {
        ("a.ts", "function", "greet", 4, 6, None), ("a.ts", "function", "load", 8, 14, None), ("a.ts", "class", "Auth", 18, 35, None),
        ("a.ts", "function", "constructor", 22, 25, "Auth"), ("a.ts", "function", "login", 27, 34, "Auth"), ("a.ts", "function", "inner", 32, 32, "Auth"),
    }
    assert calls == {
        ("a.ts", "load", "fetch", 9), ("a.ts", "load", "json", 13), ("a.ts", "Auth", "make", 20), ("a.ts", "Auth.login", "test", 28), ("a.ts", "Auth.login", "read", 28),
        ("a.ts", "Auth.login", "forEach", 29), ("a.ts", "Auth.login", "keep", 30), ("a.ts", "Auth.login.inner", "deep", 32),
    }


def test_java(spark):
    symbols, calls = frames(spark, [("S.java", "java", JAVA)])
    assert symbols == {
        ("S.java", "class", "Store", 5, 29, None), ("S.java", "function", "Store", 8, 11, "Store"), ("S.java", "function", "find", 13, 22, "Store"),
        ("S.java", "function", "later", 24, 24, "Store"), ("S.java", "class", "Part", 26, 28, None), ("S.java", "function", "size", 27, 27, "Part"),
    }
    assert calls == {
        ("S.java", "Store", "load", 6), ("S.java", "Store.Store", "init", 10), ("S.java", "Store.find", "matches", 17), ("S.java", "Store.find", "add", 17), ("S.java", "Store.find", "copy", 21),
    }


def test_go(spark):
    symbols, calls = frames(spark, [("m.go", "go", GO)])
    assert symbols == {("m.go", "function", "Get", 9, 15, None), ("m.go", "function", "Map", 17, 20, None), ("m.go", "function", "main", 22, 22, None)}
    assert calls == {
        ("m.go", "Get", "Errorf", 12), ("m.go", "Get", "clean", 14), ("m.go", "Map", "run", 18), ("m.go", "Map", "append", 19), ("m.go", "Map", "f", 19), ("m.go", "main", "Println", 22), ("m.go", "main", "len", 22),
    }


def test_dart(spark):
    symbols, calls = frames(spark, [("a.dart", "dart", DART)])
    assert {s for s in symbols if s[2] != "of"} == {
        ("a.dart", "class", "Auth", 3, 16, None), ("a.dart", "function", "Auth", 5, 5, "Auth"), ("a.dart", "function", "login", 9, 10, "Auth"),
        ("a.dart", "function", "size", 15, 15, "Auth"), ("a.dart", "function", "main", 18, 18, None),
    }
    assert {("a.dart", "Auth.login", "send", 11), ("a.dart", "Auth.login", "print", 12), ("a.dart", "main", "Auth", 19), ("a.dart", "main", "run", 20), ("a.dart", "Auth", "make", 4)} <= calls


def test_odd_sources(spark):
    rows = [
        ("e.ts", "typescript", ""), ("n.ts", "typescript", None), ("p.py", "python", "def f(): g()"), ("u.ts", "typescript", "function open() { call( {"),
        ("b.ts", "typescript", "}}} function f() { g(); }"), ("q.ts", "typescript", '"' + "\\\"" * 5000 + '" f()'), ("l.ts", "typescript", "function z() {\n" + "w();\n" * 5000 + "}"),
    ]
    symbols, calls = frames(spark, rows)
    assert ("u.ts", "function", "open", 1, 1, None) in symbols and ("z", 1, 5002) == next(s[2:5] for s in symbols if s[0] == "l.ts")
    assert {s[0] for s in symbols} <= {"u.ts", "b.ts", "l.ts"} and sum(c[0] == "l.ts" for c in calls) == 5000


def test_windows_sort_no_token_twice_by_file(spark):
    from loomgraph.sources import lexer

    files = spark.createDataFrame([("a.ts", "typescript", TS), ("b.java", "java", JAVA)], "path string, language string, content string")
    plan = lexer.marked(files)._jdf.queryExecution().executedPlan().toString()
    assert "pos#" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    backwards = [line for line in plan.splitlines() if "Sort [" in line and "DESC" in line]
    assert not backwards


def test_marks_are_neither_sorted_nor_shuffled(spark):
    """Every token went through sorts and windows of its file, which took most of the time."""
    from loomgraph.sources import lexer

    files = spark.createDataFrame([("a.ts", "typescript", TS), ("b.java", "java", JAVA)], "path string, language string, content string")
    for df, shuffles in zip(lexer.symbols_and_calls(files), (1, 2)):  # of files, and of distinct calls
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == shuffles and "Sort [" not in plan and "Window [" not in plan and "Generate " not in plan


def test_files_in_one_or_many_slices(spark, monkeypatch):
    import pyarrow as pa

    from loomgraph.sources import lexer

    rows = [(f"{k}{lang}", lang, text) for k in range(3) for lang, text in (("go", " "), ("typescript", TS), ("java", ""), ("java", JAVA), ("dart", "// x"), ("go", GO), ("dart", DART), ("go", "}"))]
    cut = lexer.tokens(spark.createDataFrame(rows, "path string, language string, content string")).collect()
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in cut])
    whole = [r for b in lexer._marks([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(lexer, "SLICE", 50)
    sliced = [b.to_pylist() for b in lexer._marks([batch])]
    assert len(sliced) > 5 and [r for b in sliced for r in b] == whole
    assert list(lexer._marks([batch.slice(0, 0)])) == []
