"""Default prompts of every task, in English and Russian: (system, user); placeholders in braces are filled from a row's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUITE = {
    "denoise": {"en": ("Remove what does not belong to the question.", "Question: {query}\nAnswer with the question alone after [Answer]."), "ru": ("Убери лишнее из вопроса.", "Вопрос: {query}\nДай только вопрос после [Answer].")},
    "enhance": {"en": ("Make the question complete and clear.", "Question: {query}\nAnswer with the better question after [Answer]."), "ru": ("Сделай вопрос полным и ясным.", "Вопрос: {query}\nДай новый вопрос после [Answer].")},
    "decompose_classify": {"en": ("Tell whether the question asks several things.", "Question: {query}\nTrue or False?"), "ru": ("Скажи, спрашивается ли о нескольких вещах.", "Вопрос: {query}\nTrue или False?")},
    "decompose": {"en": ("Split the question into simple ones, a line each.", "Question: {query}"), "ru": ("Раздели вопрос на простые, по одному в строке.", "Вопрос: {query}")},
    "entities": {"en": ("Name what the text is about, with bars between.", "Text: {query}"), "ru": ("Назови, о чём текст, через черту.", "Текст: {query}")},
    "answer": {"en": ("Answer from the facts alone.", "Facts:\n{context}\nQuestion: {query}\nAnswer after [Answer]."), "ru": ("Отвечай только по фактам.", "Факты:\n{context}\nВопрос: {query}\nОтвет после [Answer].")},
    "plan": {"en": ("Write numbered search steps.", "Question: {query}"), "ru": ("Напиши шаги поиска по номерам.", "Вопрос: {query}")},
    "plan_classify": {"en": ("Tell whether the rest of the plan must change.", "Question: {query}\nSteps: {steps}\nFound: {answers}\nTrue or False?"), "ru": ("Скажи, нужно ли менять остаток плана.", "Вопрос: {query}\nШаги: {steps}\nНайдено: {answers}\nTrue или False?")},
    "plan_enhance": {"en": ("Write the steps that are left, numbered.", "Question: {query}\nSteps: {steps}\nFound: {answers}"), "ru": ("Напиши оставшиеся шаги по номерам.", "Вопрос: {query}\nШаги: {steps}\nНайдено: {answers}")},
    "clue_query": {"en": ("Ask the question about just these things.", "Question: {query}\nThings: {names}\nAnswer after [Answer]."), "ru": ("Задай вопрос только об этом.", "Вопрос: {query}\nОб этом: {names}\nОтвет после [Answer].")},
    "clue_answer": {"en": ("Say what the facts tell about the question.", "Facts:\n{context}\nQuestion: {query}\nAnswer after [Answer]."), "ru": ("Скажи, что факты говорят о вопросе.", "Факты:\n{context}\nВопрос: {query}\nОтвет после [Answer].")},
    "clue_summary": {"en": ("Put the answers together.", "Question: {query}\nAnswers:\n{answers}\nAnswer after [Answer]."), "ru": ("Собери ответы вместе.", "Вопрос: {query}\nОтветы:\n{answers}\nОтвет после [Answer].")},
    "answer_classify": {"en": ("Tell whether what was found answers the question.", "Question: {query}\nFound: {answers}\nTrue or False?"), "ru": ("Скажи, отвечает ли найденное на вопрос.", "Вопрос: {query}\nНайдено: {answers}\nTrue или False?")},
    "final_answer": {"en": ("Answer from what was found.", "Question: {query}\nFound: {answers}\nAnswer after [Answer]."), "ru": ("Ответь по найденному.", "Вопрос: {query}\nНайдено: {answers}\nОтвет после [Answer].")},
    "aggregate": {"en": ("Make one answer of several.", "Question: {query}\nAnswers:\n{answers}\nAnswer after [Answer]."), "ru": ("Сделай из нескольких ответов один.", "Вопрос: {query}\nОтветы:\n{answers}\nОтвет после [Answer].")},
    "judge": {"en": ("Tell whether the answer means the same as the right one.", "Question: {query}\nRight: {gold}\nAnswer: {answer}\nTrue or False?"), "ru": ("Скажи, то же ли значит ответ, что и верный.", "Вопрос: {query}\nВерный: {gold}\nОтвет: {answer}\nTrue или False?")},
}


def suite(spark: SparkSession, task: str, overrides: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(lang, system, user, assistant) of a task; overrides by language, an unknown task raises."""
    if task not in SUITE:
        raise ValueError(f"no task {task!r}")
    return spark.createDataFrame([(lang, s, u, None) for lang, (s, u) in {**SUITE[task], **(overrides or {})}.items()], "lang string, system string, user string, assistant string")
