"""Named literals: the hard cases, a generated grammar, and time."""

import random
import time

import pytest

from clickstrata.llm import secrets

KEY = "Zx9k2LmQ8rT1vB7n"


def spans(text):
    return {(a, b) for a, b, _ in secrets.named_spans(text)}


def key(text, literal=KEY):
    at = text.index(literal)
    return at, at + len(literal)


@pytest.mark.parametrize("text", [
    f"password: dict[str, list[tuple[{', '.join(['int'] * 12)}]]] = \"{KEY}\"",
    f"password: dict[str, list[tuple[{', '.join(['int'] * 500)}]]] = \"{KEY}\"",
    f"def f(password: str = \"{KEY}\", n: int = 3): pass",
    f'credentials = {{"hash": "{KEY}"}}',
    f'auth = {{"a": {{"b": 1}}, "secret": {{"v": ["x", "{KEY}"]}}}}',
    f'password = prefix + "{KEY}"', f'password = "{KEY}" + suffix', f'password = a + "{KEY}" + b',
    f'password = os.getenv("DB_PASSWORD", "{KEY}")', f'token = config.get("token", "{KEY}")', f'secret = System.getProperty("s", "{KEY}")',
    f'password = [("root", "{KEY}")]', f'token = ("short", "{KEY}")', f'secret = [["a", ["{KEY}"]]]',
])
def test_literals_that_hide(text):
    assert key(text) in spans(text)


@pytest.mark.parametrize("text", [
    f'name = os.getenv("password", "{KEY}")', f'password = hashlib.new("{KEY}")', f'user: dict[str, password] = "{KEY}"',
    f'password = user\nother = "{KEY}"', f'items = {{"hash": "{KEY}"}}', f'password = name\nname = "{KEY}"', f'password = {{}}\nname = "{KEY}"',
    f'x = "{KEY}" + unknown\npassword = x',
])
def test_literals_of_other_names(text):
    assert key(text) not in spans(text)


def program(rnd):
    """A text of a small grammar, and the spans of the literals that its sensitive names get: read by hand, statement by statement."""
    text, known, want = "", {}, set()
    literal = lambda: "".join(rnd.choice("abcdefghjkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(18)) + "aB3"
    quiet, loud = ["alpha", "beta", "gamma"], ["password", "api_token", "clientSecret"]

    def put(before, value, after):
        nonlocal text
        text += before
        at = len(text)
        text += value + after
        return at, at + len(value)

    for _ in range(rnd.randint(1, 12)):
        name, sensitive = (rnd.choice(loud), True) if rnd.random() < 0.5 else (rnd.choice(quiet), False)
        form, q = rnd.randint(0, 6), rnd.choice("\"'")
        if form == 0:
            known[name] = [put(f"{name} = {q}", literal(), f"{q}\n")]
            told = known[name]
        elif form == 1:
            other = rnd.choice(quiet)
            told = known.get(other, [])
            text += f"{name} = {other}\n"
            known[name] = told
            known = {k: v for k, v in known.items() if v}
        elif form == 2:
            other = rnd.choice(quiet)
            first = known.get(other, [])
            told = [*first, put(f"{name} = {other} + {q}", literal(), f"{q}\n")]
            if first:
                known[name] = told
            else:
                known.pop(name, None)
        elif form == 3:
            known[name] = told = [put(f"{name}: {rnd.choice(['str', 'Optional[str]', 'dict[str, list[int]]'])} = {q}", literal(), f"{q}\n")]
        elif form == 4:
            told = [put(f"{name} = [{q}", literal(), f"{q}, "), put(q, literal(), f"{q}]\n")]
            known.pop(name, None)
        elif form == 5:
            told = [put(f"{name} = get({q}setting{q}, {q}", literal(), f"{q})\n")]
            known.pop(name, None)
        else:
            text += f"{name} = {{"
            told = [put(f"{q}first{q}: {q}", literal(), f"{q}, "), put(f"{q}second{q}: {{{q}third{q}: {q}", literal(), f"{q}}}}}\n")]
            known.pop(name, None)
        if sensitive:
            want |= set(told)
    return text, want


@pytest.mark.parametrize("seed", range(300))
def test_a_small_grammar(seed):
    text, want = program(random.Random(seed))
    assert spans(text) == want, text


@pytest.mark.parametrize("piece", ["[", "{", "(", "a = [", "a: b[", "a = {b: ", "password: dict[", "get(", "x = get(", '"a", ', "a + ", "])", "= [", "password = (", '["x", '])
def test_time_is_linear(piece):
    took = []
    for size in (60_000, 240_000):
        text = "password = 1\n" + piece * (size // len(piece))
        began = time.process_time()
        secrets.named_spans(text)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5
