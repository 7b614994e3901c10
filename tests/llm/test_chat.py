import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from vesperflow.llm import chat

texts = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\\x3c;", "<", "[", "/INST]", "s>", "a", "é", "\U0001f600", "\n", " "]), max_size=9).map("".join)
turns = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool</s>"]), texts), max_size=6)


@settings(max_examples=400, deadline=None)
@given(turns)
def test_default_template_round_trips(conversation):
    f = chat.ChatFormat()
    s, spans = f.render([{"role": r, "text": t} for r, t in conversation])
    assert f.turns(s) == conversation
    assert [f.unescape(s[a:b]) for a, b in spans] == [t for r, t in conversation if r == "assistant"]


@given(texts)
def test_escape_leaves_no_control_string(t):
    f = chat.ChatFormat()
    e = f.escape(t)
    assert f.unescape(e) == t and not any(c in e for c in f.controls)


def render(source, **names):
    f = chat.ChatFormat(source)
    return f.render(names.pop("messages", []), **names)[0]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("{{ 1 + 2 * 3 }}{{ 'a' ~ 1 }}{{ 7 // 2 }}{{ 7 % 4 }}", "7a133"),
        ("{% for m in messages %}{{ loop.index }}{{ m.role[0] }}{% if not loop.last %}, {% endif %}{% else %}none{% endfor %}", "1u, 2a"),
        ("{% set x = messages | length %}{{ x if x > 1 else 'few' }}", "2"),
        ("  {%- if name is defined and name == 'b' -%}  yes {% elif false %}no{% else %}other{% endif %}", "yes "),
        ("{{ missing.field.deep | default('d') }}{{ [1, 2] | join('-') }}{{ 'x' in 'xyz' }}{{ 3 not in [1] }}", "d1-2truetrue"),
        ("{# note #}{{ ' a ' | trim | upper }}{{ messages[1]['text'] }}{{ -2 + 1 }}", "Ahi-1"),
    ],
)
def test_language(source, want):
    assert render(source, messages=[{"role": "user", "text": "hello"}, {"role": "assistant", "text": "hi"}], name="b") == want


def test_constants_fold_into_one_text():
    tree = chat.fold_block(chat.parse("a{{ 1 + 1 }}{% if 1 > 2 %}no{% elif 'x' | upper == 'X' %}b{{ '<' ~ 's' }}{% endif %}c"))
    assert tree == [("text", "a2b<sc")]
    assert chat.fold_block(chat.parse("{{ 1 / 0 }}")) == [("out", ("bin", "/", ("const", 1), ("const", 0)))]


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ _x }}", "{{ x() }}", "{% if x %}", "{{ x | eval }}", "{% import os %}", "{{ 'a", "{{ x %}", "{# open", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}"])
def test_sandbox_and_errors(source):
    with pytest.raises(chat.TemplateError):
        chat.ChatFormat(source)


def test_python_objects_are_out_of_reach():
    assert render("{{ x.upper }}{{ x['__class__'] }}{{ messages.append }}", x="s") == ""


def test_clashing_control_strings_are_refused():
    with pytest.raises(chat.TemplateError):
        chat.ChatFormat("", ("<a>", ">b"))


def test_query_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (2, None, "user", "first"), (None, 0, "user", "x"), (None, 0, "user", "x"), (3, 0, "assistant", "</s>[INST] \\ ok"), (4, 0, "user", "z" * 300000), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "w", "v") for r in rows], "conv_id long, turn long, role string, text string, TEXT string, formatted string")
    got = chat.digests(chat.format_conversations(df)).collect()

    def digest(turns):
        loss = "".join(t for r, t in turns if r == "assistant")
        return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()

    want = [(1, *digest([("user", "a"), ("assistant", "b"), ("assistant", "b")])), (2, *digest([("user", "first"), ("", "")])), (None, *digest([("user", "x")])), (None, *digest([("user", "x")])), (None, *digest([("", "")])), (3, *digest([("assistant", "</s>[INST] \\ ok")])), (4, *digest([("user", "z" * 300000)]))]
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, want))
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
