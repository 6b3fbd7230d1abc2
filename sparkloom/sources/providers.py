"""Providers of summaries, tags and embeddings: mocks, and clients of APIs of the common chat and embedding shape."""

from __future__ import annotations

import json
import math
import os
import urllib.request
import zlib
from collections.abc import Callable


def mock_summary(name: str, package: str, code: str = "") -> str:
    return f"Function {name} in package {package}"


def mock_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """Hashed bags of words of unit length, all zeros for no words; the same everywhere."""
    out = []
    for text in texts:
        v = [0.0] * size
        for word in text.lower().split():
            v[zlib.crc32(word.encode()) % size] += 1.0
        n = math.sqrt(math.sumprod(v, v))
        out.append([x / n for x in v] if n else v)
    return out


# Words by which the mock tags code.
TAG_WORDS = {
    "logging": ("log.", "logger"),
    "error-handle": ("err != nil", "errors.", "error"),
    "database": ("sql.", "db."),
    "http-client": ("http.",),
    "file-io": ("os.open", "os.create", "ioutil."),
    "concurrency": ("go func", "sync.", "chan "),
}
# End of the fixed values.


def mock_tags(code: str) -> list[str]:
    low = (code or "").lower()
    return [tag for tag, words in TAG_WORDS.items() if any(w in low for w in words)]


def tags_in(answer: str, vocabulary: tuple[str, ...]) -> list[str]:
    """The valid tags of an answer that holds a JSON object, from its first brace to its last; none otherwise."""
    try:
        found = json.loads(answer[answer.index("{") : answer.rindex("}") + 1]).get("behaviors", [])
    except (ValueError, AttributeError):
        return []
    return [t for t in found if t in vocabulary] if isinstance(found, list) else []


def chat_tagger(ask: Callable[[str], str], vocabulary: tuple[str, ...]) -> Callable[[str], list[str]]:
    """A tagger that asks a chat provider for an object with a list of behaviors, and takes the valid ones."""
    task = "Which of these behaviors does this function have? Answer with a JSON object whose key behaviors has a list: " + ", ".join(vocabulary)
    return lambda code: tags_in(ask(f"{task}\nCode: {code}"), vocabulary)


def prompt(name: str, package: str, signature: str = "", docstring: str = "", code: str = "", task: str = "Summarise this function in one or two sentences.") -> str:
    parts = {"Package": package, "Name": name, "Signature": signature, "Documentation": docstring, "Code": code}
    return "\n".join([task, *(f"{k}: {v}" for k, v in parts.items() if v)])


def _post(url: str, key: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def embedding_client(base: str, key: str, model: str, timeout: float = 30.0, post: Callable = _post) -> Callable[[list[str]], list[list[float]]]:
    """A function of a batch of texts, sent as one request; the answers are put in order by their index."""

    def embed(texts: list[str]) -> list[list[float]]:
        data = post(f"{base.rstrip('/')}/embeddings", key, {"model": model, "input": texts}, timeout)["data"]
        if len(data) != len(texts):
            raise ValueError(f"{len(texts)} texts, {len(data)} embeddings")
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]

    return embed


def chat_client(base: str, key: str, model: str, timeout: float = 30.0, post: Callable = _post) -> Callable[[str], str]:
    def ask(text: str) -> str:
        body = {"model": model, "messages": [{"role": "user", "content": text}]}
        return post(f"{base.rstrip('/')}/chat/completions", key, body, timeout)["choices"][0]["message"]["content"].strip()

    return ask


def from_environment(kind: str, environment: dict[str, str] | None = None) -> Callable | None:
    """The embedding or chat client that the environment configures (KIND_PROVIDER, _BASE, _KEY, _MODEL), or None."""
    env = os.environ if environment is None else environment
    get = lambda name: env.get(f"{kind.upper()}_{name}", "")
    if not get("PROVIDER") or get("PROVIDER") == "none":
        return None
    make = embedding_client if kind == "embedding" else chat_client
    return make(get("BASE"), get("KEY"), get("MODEL"))
