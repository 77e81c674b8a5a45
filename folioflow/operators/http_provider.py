"""A provider over an HTTP chat-completions service, built once per Python worker."""

from __future__ import annotations

import base64
import json
import urllib.request
from dataclasses import dataclass

from folioflow.config import Settings
from folioflow.prompts import fill, load

#: The fields and the name of the tool that a classification is asked for with.
FIELDS = {
    "is_exam": {"type": "boolean"}, "exam_name_raw": {"type": ["string", "null"]}, "exam_date": {"type": ["string", "null"]},
    "facility_name": {"type": ["string", "null"]}, "physician_name": {"type": ["string", "null"]}, "department": {"type": ["string", "null"]},
}
TOOL = {"type": "function", "function": {"name": "classify_document", "parameters": {"type": "object", "properties": FIELDS, "required": ["is_exam"]}}}


@dataclass
class HttpProvider:
    """Fixed values are each call's temperature and output bound; failures raise, and the operators say what follows."""

    settings: Settings
    timeout: float = 300.0

    def _call(self, model: str, system: str, content, temperature: float, most: int, **more) -> dict:
        body = {"model": model, "temperature": temperature, "max_tokens": most, "messages": [{"role": "system", "content": system}, {"role": "user", "content": content}], **more}
        request = urllib.request.Request(
            self.settings.base_url.rstrip("/") + "/chat/completions",
            data=json.dumps(body).encode(),
            headers={"Content-Type": "application/json", "Authorization": f"Bearer {self.settings.api_key}"},
        )
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]

    def _text(self, *args, **more) -> str:
        return (self._call(*args, **more).get("content") or "").strip()

    @staticmethod
    def _image(image: bytes) -> dict:
        return {"type": "image_url", "image_url": {"url": "data:image/jpeg;base64," + base64.b64encode(image).decode()}}

    def classify(self, pages: list[bytes], context: str = "") -> dict:
        content = [{"type": "text", "text": context or "Classify this document."}, *map(self._image, pages)]
        choice = {"type": "function", "function": {"name": "classify_document"}}
        message = self._call(self.settings.classify_model, load("classify_system"), content, 0.1, 1024, tools=[TOOL], tool_choice=choice)
        return json.loads(message["tool_calls"][0]["function"]["arguments"])

    def transcribe(self, image: bytes, variant: str, temperature: float, context: str = "") -> str:
        found = self._text(self.settings.extract_model, fill(variant, context=context), [{"type": "text", "text": "Transcribe this page."}, self._image(image)], temperature, 16384)
        from folioflow.operators.providers import strip_fences_text

        plain = strip_fences_text(found)
        if plain.startswith("{"):
            try:
                parsed = json.loads(plain)
            except ValueError:
                return plain
            if isinstance(parsed, dict) and isinstance(parsed.get("transcription"), str):
                return parsed["transcription"]
        return plain

    def is_refusal(self, text: str) -> bool:
        return "yes" in self._text(self.settings.validation_model, load("refusal_system"), text, 0.0, 10).lower()

    def vote(self, samples: list[str]) -> str:
        listed = "\n\n".join(f"--- {k} ---\n{s}" for k, s in enumerate(samples, 1))
        return self._text(self.settings.self_consistency_model, load("vote_system"), listed, 0.1, 16384)

    def score(self, merged: str, samples: list[str]) -> str:
        listed = "\n\n".join([f"--- merged ---\n{merged}", *(f"--- {k} ---\n{s}" for k, s in enumerate(samples, 1))])
        return self._text(self.settings.self_consistency_model, load("score_system"), listed, 0.1, 1024)

    def standardize(self, names: list[str]) -> str:
        return self._text(self.settings.extract_model, load("standardize_system"), json.dumps(names, ensure_ascii=False), 0.1, 4000)

    def summarize(self, system: str, prompt: str) -> str:
        return self._text(self.settings.summarize_model, system, prompt, 0.1, 4000)
