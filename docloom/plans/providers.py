"""Clients of model services: what each is sent and how its replies are read. How requests travel is given from outside.

A transport takes a URL, headers and a JSON body and gives a status and a JSON body; post() is the one of the standard library.
"""

from __future__ import annotations

import base64
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from docloom.plans.models import ClientFactory, RateLimited, Reply, Spec

Json = dict[str, Any]
Transport = Callable[[str, dict[str, str], Json], tuple[int, Json]]
#: Statuses after which a service is asked again: too many requests, or overloaded.
AGAIN = frozenset({429, 503, 529})


class ServiceError(Exception):
    """A service refused a request for good."""


def post(url: str, headers: dict[str, str], body: Json) -> tuple[int, Json]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request) as r:
            return r.status, json.loads(r.read() or b"{}")
    except urllib.error.HTTPError as e:
        return e.code, {"error": e.read().decode("utf-8", "replace")}


def kind_of_image(image: bytes) -> str:
    """An image's media type by its first bytes; JPEG if they say nothing else."""
    for mark, kind in ((b"\x89PNG", "png"), (b"GIF8", "gif"), (b"RIFF", "webp")):
        if image.startswith(mark):
            return f"image/{kind}"
    return "image/jpeg"


@dataclass(frozen=True)
class Service:
    """How one kind of service is spoken to: of a spec, its key, a prompt and images a URL, headers and body; of a reply's body text and token counts."""

    request: Callable[[Spec, str, str, list[bytes]], tuple[str, dict[str, str], Json]]
    read: Callable[[Json], Reply]
    key: str | None


def _encoded(image: bytes) -> str:
    return base64.b64encode(image).decode()


def _chat(base: str):
    """Requests of the form that several services share: messages of roles with typed parts."""

    def request(spec: Spec, key: str, prompt: str, images: list[bytes]) -> tuple[str, dict[str, str], Json]:
        parts: Any = prompt
        if images:
            parts = [{"type": "text", "text": prompt}, *({"type": "image_url", "image_url": {"url": f"data:{kind_of_image(i)};base64,{_encoded(i)}"}} for i in images)]
        messages = [{"role": "system", "content": spec.system}] * bool(spec.system) + [{"role": "user", "content": parts}]
        return f"{spec.endpoint or base}/chat/completions", {"Authorization": f"Bearer {key}"}, {"model": spec.name, "messages": messages, "max_tokens": spec.max_answer, "temperature": spec.temperature}

    return request


def _read_chat(body: Json) -> Reply:
    choices, usage = body.get("choices") or [], body.get("usage") or {}
    return Reply((choices[0]["message"].get("content") or "") if choices else "", usage.get("prompt_tokens"), usage.get("completion_tokens"))


def _azure(spec: Spec, key: str, prompt: str, images: list[bytes]) -> tuple[str, dict[str, str], Json]:
    if not spec.endpoint or not spec.api_version:
        raise ValueError(f"{spec.model_id} needs an endpoint and a version of its interface")
    _, _, body = _chat("")(spec, key, prompt, images)
    del body["model"]
    return f"{spec.endpoint}/openai/deployments/{spec.name}/chat/completions?api-version={spec.api_version}", {"api-key": key}, body


def _anthropic(spec: Spec, key: str, prompt: str, images: list[bytes]) -> tuple[str, dict[str, str], Json]:
    parts = [{"type": "text", "text": prompt}, *({"type": "image", "source": {"type": "base64", "media_type": kind_of_image(i), "data": _encoded(i)}} for i in images)]
    body = {"model": spec.name, "max_tokens": spec.max_answer, "temperature": spec.temperature, "messages": [{"role": "user", "content": parts}]} | ({"system": spec.system} if spec.system else {})
    return f"{spec.endpoint or 'https://api.anthropic.com/v1'}/messages", {"x-api-key": key, "anthropic-version": spec.api_version or "2023-06-01"}, body


def _read_anthropic(body: Json) -> Reply:
    usage = body.get("usage") or {}
    return Reply(next((p["text"] for p in body.get("content") or [] if "text" in p), ""), usage.get("input_tokens"), usage.get("output_tokens"))


def _cohere(spec: Spec, key: str, prompt: str, images: list[bytes]) -> tuple[str, dict[str, str], Json]:
    body = {"model": spec.name, "message": prompt, "max_tokens": spec.max_answer, "temperature": spec.temperature} | ({"preamble": spec.system} if spec.system else {})
    return f"{spec.endpoint or 'https://api.cohere.com/v1'}/chat", {"Authorization": f"Bearer {key}"}, body


def _read_cohere(body: Json) -> Reply:
    units = (body.get("meta") or {}).get("billed_units") or {}
    return Reply(body.get("text") or "", units.get("input_tokens"), units.get("output_tokens"))


def _google(spec: Spec, key: str, prompt: str, images: list[bytes]) -> tuple[str, dict[str, str], Json]:
    parts = [{"text": prompt}, *({"inline_data": {"mime_type": kind_of_image(i), "data": _encoded(i)}} for i in images)]
    body: Json = {"contents": [{"role": "user", "parts": parts}], "generationConfig": {"temperature": spec.temperature, "maxOutputTokens": spec.max_answer}}
    if spec.system:
        body["systemInstruction"] = {"parts": [{"text": spec.system}]}
    return f"{spec.endpoint or 'https://generativelanguage.googleapis.com/v1beta'}/models/{spec.name}:generateContent", {"x-goog-api-key": key}, body


def _read_google(body: Json) -> Reply:
    found, usage = body.get("candidates") or [], body.get("usageMetadata") or {}
    parts = (found[0].get("content") or {}).get("parts") or [] if found else []
    return Reply("".join(p.get("text", "") for p in parts), usage.get("promptTokenCount"), usage.get("candidatesTokenCount"))


def _ollama(spec: Spec, key: str, prompt: str, images: list[bytes]) -> tuple[str, dict[str, str], Json]:
    user: Json = {"role": "user", "content": prompt} | ({"images": [_encoded(i) for i in images]} if images else {})
    messages = [{"role": "system", "content": spec.system}] * bool(spec.system) + [user]
    return f"{spec.endpoint or 'http://localhost:11434'}/api/chat", {}, {"model": spec.name, "messages": messages, "stream": False, "options": {"temperature": spec.temperature, "num_predict": spec.max_answer}}


def _read_ollama(body: Json) -> Reply:
    return Reply((body.get("message") or {}).get("content") or "", body.get("prompt_eval_count"), body.get("eval_count"))


def _replicate(spec: Spec, key: str, prompt: str, images: list[bytes]) -> tuple[str, dict[str, str], Json]:
    given = {"prompt": prompt, "max_tokens": spec.max_answer, "temperature": spec.temperature} | ({"system_prompt": spec.system} if spec.system else {})
    return f"{spec.endpoint or 'https://api.replicate.com/v1'}/models/{spec.name}/predictions", {"Authorization": f"Bearer {key}", "Prefer": "wait"}, {"input": given}


def _read_replicate(body: Json) -> Reply:
    out, usage = body.get("output") or "", body.get("metrics") or {}
    return Reply("".join(out) if isinstance(out, list) else out, usage.get("input_token_count"), usage.get("output_token_count"))


SERVICES = {
    "gpt": Service(_chat("https://api.openai.com/v1"), _read_chat, "OPENAI_API_KEY"),
    "azure": Service(_azure, _read_chat, "AZURE_OPENAI_API_KEY"),
    "anthropic": Service(_anthropic, _read_anthropic, "ANTHROPIC_API_KEY"),
    "cohere": Service(_cohere, _read_cohere, "COHERE_API_KEY"),
    "google": Service(_google, _read_google, "GOOGLE_API_KEY"),
    "mistral": Service(_chat("https://api.mistral.ai/v1"), _read_chat, "MISTRAL_API_KEY"),
    "ollama": Service(_ollama, _read_ollama, None),
    "replicate": Service(_replicate, _read_replicate, "REPLICATE_API_TOKEN"),
    "together": Service(_chat("https://api.together.xyz/v1"), _read_chat, "TOGETHER_API_KEY"),
}


class ServiceClient:
    """A client of the service that a spec's kind names. The key is the spec's, or is read from the environment where the client runs."""

    def __init__(self, spec: Spec, transport: Transport = post) -> None:
        self.spec, self.service, self.transport = spec, SERVICES[spec.kind], transport
        self.key = spec.api_key or (os.environ.get(self.service.key, "") if self.service.key else "")

    def ask(self, prompt: str, images: list[bytes]) -> Reply:
        shown = images if self.spec.multimodal else []
        status, body = self.transport(*self.service.request(self.spec, self.key, prompt, shown if self.spec.max_images is None else shown[: self.spec.max_images]))
        if status in AGAIN:
            raise RateLimited(f"{self.spec.model_id}: status {status}")
        if status >= 400:
            raise ServiceError(f"{self.spec.model_id}: status {status}: {body.get('error')}")
        return self.service.read(body)


def factories(transport: Transport = post) -> dict[str, ClientFactory]:
    """A factory of clients for each kind of service, as a Registry takes them."""
    return {kind: lambda spec: ServiceClient(spec, transport) for kind in SERVICES}
