"""Declared schemas of what the readers give."""

CHOICE = "struct<label: string, text: string>"
QUESTION = (
    "ord bigint, id string, q_type string, question struct<stem: string, choices: array<" + CHOICE + ">>, answer_key string, "
    "images array<string>, skillref array<string>, step_name array<string>, ds_step_name array<string>, "
    "skill string, subject string, topic string, category string, grade string, extras map<string,string>"
)
#: Keys of a stored question and the columns they become; any other goes to ``extras``.
QUESTION_KEYS = {
    "id": "id",
    "type": "q_type",
    "question": "question",
    "answerKey": "answer_key",
    "images": "images",
    "skillref": "skillref",
    "step-name": "step_name",
    "ds-step-name": "ds_step_name",
    "skill": "skill",
    "subject": "subject",
    "topic": "topic",
    "category": "category",
    "grade": "grade",
}
STUDENT_STEP = "`Anon Student Id` string, `Problem Hierarchy` string, `Problem Name` string, `Step Name` string, `First Transaction Time` string, `First Attempt` string"
STEP_COLUMNS = {
    "Anon Student Id": "anon_student_id",
    "Problem Hierarchy": "problem_hierarchy",
    "Problem Name": "problem_name",
    "Step Name": "step_name",
    "First Transaction Time": "first_transaction_time",
    "First Attempt": "first_attempt",
}
KC_VALUES = "_c0 int, kc_name string, n_steps int, n_obs int, intercept_logit double, intercept_prob double, slope double"
CV_RESULT = "name string"
