from cartolith.operators import cpp_facts

SOURCE = """
#include "x.h"
#define CALL(x) \\
    never(x)
namespace app::core {
class Parser final : public Base<int> {
public:
    explicit Parser(int n) : n_(n), m_{make()} { reset(); }
    int next() const { return step(1) + other->run(); }
    bool operator<(const Parser& o) const { return n_ < o.n_; }
private:
    int n_ = compute_default;
};
enum class Mode { A, B };
template <typename T>
T pick(T a, T b) { if (a < b) { return helper(a); } return b; }
static const char* kText = R"(fake() { class X {})";
}  // namespace app::core
int app::core::Parser::step(int k) { Widget w(k); // skipped()
    auto f = [](int x) { return inner(x); }; return "quoted()"[0] + free_call(f); }
int main() { return app::core::pick(1, 2); }
"""


def test_scopes_and_calls():
    symbols, calls = cpp_facts.scan(SOURCE)
    assert {(k, q) for k, _, q, _ in symbols} == {
        ("namespace", "app::core"), ("class", "app::core::Parser"), ("method", "app::core::Parser::Parser"), ("method", "app::core::Parser::next"), ("method", "app::core::Parser::operator<"), ("enum", "app::core::Mode"),
        ("function", "app::core::pick"), ("method", "app::core::Parser::step"), ("function", "main"),
    }
    assert {(c, t, n) for _, c, t, n, _ in calls} == {
        ("reset", "app::core::Parser", "app::core"), ("step", "app::core::Parser", "app::core"), ("run", "app::core::Parser", "app::core"), ("helper", "", "app::core"), ("inner", "app::core::Parser", ""), ("free_call", "app::core::Parser", ""), ("app::core::pick", "", ""),
    }
    assert dict((q, n) for _, _, q, n in symbols)["main"] == 21


def test_calls_resolve_by_scope(spark):
    files = spark.createDataFrame([("p", "a.cpp", SOURCE), ("p", "b.cpp", "namespace app::core { void helper(int) { } }\nvoid reset() { }\nnamespace z { void reset() { } }"), ("q", "c.cpp", "void helper() { }"), ("p", "n.cpp", None), ("p", "x.py", "def f(): pass")], "project_id string, path string, content string")
    got = {r.callee: (r.target, r.rung) for r in cpp_facts.resolved_calls(files).collect()}
    assert got["helper"] == ("app::core::helper", 3) and got["step"] == ("app::core::Parser::step", 2) and got["app::core::pick"] == ("app::core::pick", 1) and got["reset"] == ("reset", 1) and got["run"] == (None, None)
    assert cpp_facts.cpp_symbols(files.limit(0)).count() == 0


def test_long_parameter_lists_and_tables_change_no_facts():
    params = ", ".join(f"const std::vector<int>& value_{k}" for k in range(200))
    symbols, calls = cpp_facts.scan(f"namespace n {{ int wide({params}) {{ return fold({', '.join(f'a{k}' for k in range(900))}); }} }}\nint t[] = {{{', '.join('f(1)' for _ in range(800))}}};\nvoid g() {{ h(); h(); }}\n")
    assert [(s[0], s[2]) for s in symbols if s[0] == "function"] == [("function", "n::wide"), ("function", "g")]
    assert [c[1] for c in calls] == ["fold", "h", "h"]
