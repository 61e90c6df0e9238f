from veritrace.operators.blocks import cut_long, segment
from veritrace.operators.symbols import parse

JAVA = '''
/** Orders. */
@RequestMapping({"/api/order", "/v2", "plain"})
public class OrderController<T extends Map<String, Integer>> {
  private int a, b = f(1, 2), c;
  Map<String, List<Integer>> m = new HashMap<>() {{ put("x {", 1); }};
  Runnable r = () -> { int z = 1; };
  static { int q = 3; }
  /* made */ public OrderController(int x) { this.a = x; }
  @GetMapping(value = "/list") @X("no") public <K> List<K> list(@P("a") K k) { Object o = new Object() { void inner() {} }; return null; }
  interface Nested { void go(int a); }
  enum Color { RED("r"), GREEN, BLUE; int v; }
  enum Bare { A, B }
  // class Fake { int no; }
  String s = "class Hidden { int x; }";
}
'''


def names(rows):
    return [r["name"] for r in rows]


def test_java_members():
    found = parse(JAVA)
    assert names(found.types) == ["OrderController", "Nested", "Color", "Bare"]
    assert found.types[0]["base_paths"] == ["/api/order", "/v2"] and found.types[0]["doc"] == "Orders."
    assert names(found.methods) == ["OrderController", "list", "go"]
    assert found.methods[0]["doc"] == "made" and found.methods[1]["annotations"] == [("GetMapping", ["/list"]), ("X", ["no"])]
    assert sorted(names(found.fields)) == ["a", "b", "c", "m", "r", "s", "v"]
    assert names(found.enum_constants) == ["RED", "GREEN", "BLUE"]
    assert names(parse(JAVA, lenient_enum=True).enum_constants) == ["RED", "GREEN", "BLUE", "A", "B"]


def test_java_survives_anything():
    for text in ("", "class", "class A {", "}}}}", '"', "/*", "@", "class A { int", '"""x'):
        parse(text)


def test_blocks():
    text = "# A\n\n### B\n\n### C\n- x\n  y\n\n- z\n\na | b\n-- | --\n1 | 2\n\n```\n# no\n```\n> q\n\n> r\npara\nmore\n"
    rows = [(a, b, path, kind) for a, b, path, kind, _ in segment(text)]
    assert rows == [
        (1, 1, ["A"], "heading"), (3, 3, ["A", "B"], "heading"), (5, 5, ["A", "B", "C"], "heading"), (6, 9, ["A", "B", "C"], "list"),
        (11, 13, ["A", "B", "C"], "table"), (15, 17, ["A", "B", "C"], "code"), (18, 20, ["A", "B", "C"], "quote"), (21, 22, ["A", "B", "C"], "para"),
    ]


def test_long_blocks():
    assert cut_long([False] * 40, 40) == [(0, 40)]
    assert cut_long([False] * 90, 40) == [(0, 40), (40, 80), (80, 90)]
    blank = [i == 25 for i in range(60)]
    assert cut_long(blank, 40) == [(0, 25), (26, 60)]
