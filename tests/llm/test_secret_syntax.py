import time

import pytest

from pairlens.llm.secrets import literal_spans

KEY = "k9Xq2LmZ7vR4"


@pytest.mark.parametrize("text", [
    f'password: str = "{KEY}"', f"let token: Option<String> = Some('{KEY}')", f'const secret: &str = "{KEY}";', f"#define API_SECRET \"{KEY}\"", f"# define PASSWORD {KEY}",
    f'password = f("{KEY}")', f'password = conf.get("db.password", "{KEY}")', f'api_secret=x1="{KEY}"', f'token = other = third = "{KEY}"', f"secret = `{KEY}`",
    f'secret = sha256_hex("{KEY}")', f'x = "{KEY}"\nclient_secret: x', f'a = b = "{KEY}"\npassword := a', f'"api-token": "{KEY}"', f"<password>{KEY}</password>", f'token = "{KEY[:6]}" + "{KEY}"',
])
def test_finds(text):
    assert KEY in [text[a:b] for a, _, b in literal_spans(text)]


def test_an_escaped_quotation_mark_does_not_end_a_string():
    text = r'token = "k9Xq\"2LmZ7vR4" + x'
    assert [text[a:b] for a, _, b in literal_spans(text)] == [r"k9Xq\"2LmZ7vR4"]


@pytest.mark.parametrize("text", ['password = os.getenv("DATABASE_PASSWORD")', f'colour: str = "{KEY}"', f'host: key2 = f("{KEY}")', "secret = make_secret256()", 'token = "a few words here"', "", "#define", "a = b = ", "x" * 50])
def test_leaves_alone(text):
    assert literal_spans(text) == []


def test_hostile_texts_take_linear_time():
    for made in (lambda n: "a = f(" * n, lambda n: "a=b=" * n, lambda n: 'a = "' + "\\" * n, lambda n: "x: " + "y" * n + "<" * n, lambda n: "#define " * n, lambda n: "a: b[" * n):
        began = time.process_time()
        literal_spans(made(20_000))
        assert time.process_time() - began < 5
