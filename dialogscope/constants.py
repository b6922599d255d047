"""Fixed values of the dialog data model.

Everything in this module is a FIXED VALUE that must equal the source
dashboard's text exactly (tag strings, stage names, block keywords, labels,
month names), otherwise filters and funnels silently count nothing.  They are
stated plainly, in their natural order, and nowhere else in the package.
"""

from __future__ import annotations

# --- FIXED VALUES: stage-1 ("matching") tags, in funnel order -------------
TAG_EMPTY = "(-) ничего не ввели"
TAG_TASK = "(-) ввели задачу"
TAG_NOT_MATH = "(-) ввели тему не по математике"
TAG_OUT_OF_GRADES = "(-) ввели мат тему не 5-11"
TAG_LEFT_AFTER_MATCH = "(-) ушли после мэтчинга"
TAG_SUCCESS = "(-) всё хорошо"
# Tags that occur in the data but are not funnel steps (they end up in the
# residual of the last stage).
TAG_COMING_SOON = "(-) ввели тему, которой пока нет, но будет"
TAG_MATCH_FAILED = "(-) мэтчинг не сработал"

# --- FIXED VALUES: stage-2 ("post-matching") tags, in funnel order -------
POST_AFTER_PLAN = "(-) ушли после плана"
POST_AFTER_STEP1 = "(-) ушли после первого шага"
POST_AFTER_STEP2 = "(-) ушли после 2-го и более шага"
POST_SAW_FINAL = "(-) увидели финальную задачу"
POST_SOLVED = "(-) решили финальную задачу"

# --- FIXED VALUES: funnel stage names (matching funnel) -------------------
MATCHING_TOTAL_STAGE = "📥 Всего диалогов"
MATCHING_STEPS = [
    ("✅ Без пустых запросов", TAG_EMPTY),
    ("✅ Без задач вместо темы", TAG_TASK),
    ("✅ По математике", TAG_NOT_MATH),
    ("✅ 5-11 класс", TAG_OUT_OF_GRADES),
    ("✅ Не ушли сразу", TAG_LEFT_AFTER_MATCH),
]
MATCHING_SUCCESS = ("🎉 Успешный мэтчинг", TAG_SUCCESS)

# --- FIXED VALUES: funnel stage names (post-matching funnel) --------------
POST_TOTAL_STAGE = "🎉 Успешный мэтчинг"
POST_STEPS = [
    ("📋 Увидели план", POST_AFTER_PLAN),
    ("🚶 Прошли шаг 1", POST_AFTER_STEP1),
    ("🚶🚶 Прошли 2+ шага", POST_AFTER_STEP2),
    ("🎯 Увидели финал", POST_SAW_FINAL),
]
POST_SUCCESS = ("🏆 Решили финал", POST_SOLVED)

# --- FIXED VALUES: the sectioned tag report ------------------------------
# Stage-1 rows in report order: success first, then (after a rule row) the
# interruption tags; the section total is the count of uninterrupted dialogs.
STAGE1_REPORT_TAGS = [
    TAG_SUCCESS,
    TAG_EMPTY,
    TAG_TASK,
    TAG_NOT_MATH,
    TAG_OUT_OF_GRADES,
    TAG_COMING_SOON,
    TAG_LEFT_AFTER_MATCH,
    TAG_MATCH_FAILED,
]
# Stage-2 rows in report order (the report lists four of the five tags).
STAGE2_REPORT_TAGS = [POST_SOLVED, POST_SAW_FINAL, POST_AFTER_STEP1, POST_AFTER_PLAN]
REPORT_BANNER = "📊 ОБЩАЯ СТАТИСТИКА ДИАЛОГОВ"
REPORT_RULE = "═" * 39
REPORT_STAGE1_TITLE = "📌 ЭТАП 1: МЭТЧИНГ (все диалоги)"
REPORT_STAGE1_HEADER = ["Тег", "Количество", "Процент от диалогов без прерывания", ""]
REPORT_STAGE2_TITLE = '📌 ЭТАП 2: ПОСТ-МЭТЧИНГ (только "всё хорошо")'
REPORT_STAGE2_HEADER = ["Тег", "Количество", "% от успешных", "% от всех"]
REPORT_STAGE2_TOTAL = "ИТОГО"
REPORT_CONVERSION_TITLE = "📊 ВОРОНКА КОНВЕРСИИ"
REPORT_CONVERSION_HEADER = ["Этап", "Количество", "% от начала", ""]

# --- FIXED VALUES: conversion-table stage names ---------------------------
CONVERSION_STAGES = [
    "Всего диалогов",
    "Диалоги без прерывания сценария",
    "Успешный мэтчинг",
    "Решили финальную задачу",
]

# --- FIXED VALUES: skeleton block keywords and display labels -------------
BLOCK_TYPES = ["plan", "info", "action", "problem", "bossaction", "summary", "other"]
BLOCK_LABELS = {
    "plan": "📋 План",
    "info": "📚 Теория",
    "action": "❓ Вопрос",
    "problem": "🎯 Финал",
    "bossaction": "🔧 Подсказка",
    "summary": "✅ Итог",
}
# Block types that reset the nesting depth to zero.
RESET_TYPES = ["plan", "info", "problem", "summary"]
# Block types that go one level deeper (and count as a drop-off when last).
DEEPER_TYPES = ["action", "bossaction"]
# Extra dialog lines shown after each block's share of the dialog text.
EXCERPT_CONTEXT_LINES = 5

# --- FIXED VALUES: filter sentinel, months ---------------------------------
ALL = "Все"
MONTH_PREFIX = {"Январь": "jan", "Февраль": "feb", "Март": "mar", "Апрель": "apr"}

# --- FIXED VALUES: source column names of the monthly tables --------------
SRC_SESSION_SECONDS = "Время сессии в секундах"
SRC_PUPIL_MSGS = "Сообщений ученика"
SRC_TUTOR_MSGS = "Сообщений тьютора"
SRC_MONTH = "Месяц"
SRC_SKELETON = "Скелет"
SRC_SKELETON_LOWER = "скелет"
SRC_DIALOG_TEXT = "Диалог"
SRC_TAG = "Тег"
SRC_GRADE = "Класс"
SRC_SUBJECT = "Предмет"
SRC_PUPILS = "Количество учеников"

# Source column name -> canonical column name used throughout the package.
DIALOG_COLUMNS = {
    "dialog_id": "dialog_id",
    "activity_dt": "activity_dt",
    "dialog_grade": "dialog_grade",
    "dialog_role": "dialog_role",
    "product_slug": "product_slug",
    "status_only": "status",
    "status_only_post": "status_post",
    SRC_SESSION_SECONDS: "session_seconds",
    SRC_PUPIL_MSGS: "pupil_msgs",
    SRC_TUTOR_MSGS: "tutor_msgs",
    SRC_MONTH: "month",
}
CLASS_COLUMNS = {SRC_GRADE: "grade", SRC_SUBJECT: "subject", SRC_PUPILS: "pupils"}
# Name parts that mark a session-metric column ("time", "messages").
METRIC_NAME_PARTS = ["Время", "Сообщений"]

# Characters Python's str.strip() removes (str.isspace() is true), as one
# regex character class usable by both Java regex and RE2.
PY_WHITESPACE_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
