"""Prompt texts and their slots, in our own words."""

from __future__ import annotations

import json

#: Names of the transcription prompts in the order in which they are tried.
VARIANTS = ("transcription_system", "transcription_system_alt1", "transcription_system_alt2", "transcription_system_alt3")

#: Ranges of confidence (fixed values) and what they stand for.
CONFIDENCE = (
    (1.0, 1.0, "the same content throughout"),
    (0.7, 0.9, "a few words apart, none that a reader would act on"),
    (0.4, 0.6, "a figure, unit or statement apart, while the findings stay what they are"),
    (0.1, 0.3, "findings or values that contradict or lack each other"),
    (0.0, 0.0, "no common content"),
)
#: Categories (fixed values) and how to tell them.
CATEGORIES = (
    ("imaging", "pictures by radiation or magnetism"),
    ("ultrasound", "pictures or flow by sound, of the heart too"),
    ("endoscopy", "a look inside by an instrument that is led in"),
    ("prescription", "orders of medicines"),
    ("appointment", "times and summons, without a finding"),
    ("other", "curves and functions of organs, tissue samples, and all else"),
)
#: Names with their category and standard name.
EXAMPLES = (
    ("Radiografia do Tórax", "imaging", "Chest X-ray"),
    ("Ecografia Abdominal", "ultrasound", "Abdominal Ultrasound"),
    ("EDA", "endoscopy", "Upper GI Endoscopy"),
    ("Eletrocardiograma", "other", "ECG"),
    ("RM Cerebral", "imaging", "Brain MRI"),
    ("Receita Médica", "prescription", "Prescription"),
    ("Prescrição", "prescription", "Prescription"),
    ("Marcação de Consulta", "appointment", "Appointment"),
    ("Convocatória", "appointment", "Appointment"),
)

PROMPTS = {
    "classify_system": "Decide from all pages whether this is a medical exam document. Pages with results, findings or filled exam forms make it one, together with cover letters that belong to them. Invoices and general letters are none. In doubt, it is one. Report is_exam, exam_name_raw, exam_date (when performed, else issued), facility_name, physician_name and department.",
    "transcription_system": "Copy the text of the page exactly as it stands, in its language and layout. Correct nothing. Write [illegible] for what cannot be read, [X] and [ ] for boxes, and line up tables. Describe a page without text in one plain sentence. {context}",
    "transcription_system_alt1": "Type out the visible text of this scanned page, line by line, unchanged. {context}",
    "transcription_system_alt2": "This is a document archive task. Reproduce the characters printed on the page and nothing else. {context}",
    "transcription_system_alt3": "Read the image as an OCR engine would and return its text. {context}",
    "refusal_system": "Answer yes if the text is a refusal to transcribe instead of a page's content, else no.",
    "vote_system": "Several transcriptions of one page follow. Return one text that has the reading of the majority at each place, else the most complete one; medical terms and figures come first. Return the text only.",
    "score_system": "A merged transcription and those it was made of follow. Rate from 0 to 1 how far these agree with it in content: the same findings, values and conclusions, nothing of weight missing from some, the same terms, measures, dates and names. Blanks, line breaks and punctuation that changes no meaning do not count.\n"
    + "\n".join(f"- {low:g} to {high:g}: {meaning}" if low < high else f"- {low:g}: {meaning}" for low, high, meaning in CONFIDENCE)
    + "\nAnswer as JSON with confidence and reasoning, the latter in one or two sentences.",
    "standardize_system": "For every exam name, Portuguese or English, give exam_type and a standardized English name, as a JSON object by name.\n"
    + "\n".join(f"- {kind}: {members}" for kind, members in CATEGORIES)
    + "\nExamples:\n"
    + json.dumps({name: {"exam_type": kind, "standardized_name": standard} for name, kind, standard in EXAMPLES}, ensure_ascii=False, indent=1),
    "summary_system": "Write an English clinical summary in prose. Keep findings, values, impressions, recommendations and dates. Leave out who the patient, the doctors and the facilities are, letterheads and repetitions.",
    "summary_first": "{n} exams:\n{exam_list}\n\n{transcriptions}\n\nSummarise them.",
    "summary_next": "Summary so far:\n{summary}\n\n{n} more exams:\n{exam_list}\n\n{transcriptions}\n\nWork them into the summary and lose nothing.",
}


def load(name: str) -> str:
    """A prompt by name; an unknown one is an error."""
    if name not in PROMPTS:
        raise FileNotFoundError(f"no prompt named {name!r}")
    return PROMPTS[name].strip()


def fill(name: str, **values) -> str:
    """A prompt with its slots filled in one pass, so that braces in a value stay as they are."""
    import re

    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], load(name))


def patient_context(full_name: str | None, birth_date: str | None, locale: str | None) -> str:
    """What a model should know of the patient; empty without a name or a birth date."""
    if not (full_name or birth_date):
        return ""
    parts = []
    if full_name:
        parts.append(f"The patient is {full_name}.")
    if birth_date:
        parts.append(f"The date of birth {birth_date} is not an exam date.")
    if locale:
        parts.append(f"The locale is {locale}.")
    return " ".join(parts)
