"""Table and feed schemas as DDL text (column names are fixed values)."""

from __future__ import annotations

from functools import cache

from pyspark.sql.types import StructType

_TABLES: dict[str, str] = {
    "users": "user_id long, email string, sis_user_id string, login_id string, updated_at timestamp",
    "courses": "course_id long, name string, course_code string, workflow_state string, start_at timestamp, "
               "end_at timestamp, time_zone string, updated_at timestamp",
    "enrollments": "enrollment_id long, course_id long, user_id long, type string, role string, "
                   "enrollment_state string, last_activity_at timestamp, total_activity_time int, "
                   "current_score double, final_score double, created_at timestamp, updated_at timestamp",
    "assignments": "assignment_id long, course_id long, name string, description string, due_at timestamp, "
                   "unlock_at timestamp, lock_at timestamp, points_possible double, grading_type string, "
                   "submission_types string, published int, due_at_roadmap timestamp, updated_at timestamp",
    "submissions": "submission_id long, assignment_id long, user_id long, score double, grade string, "
                   "submitted_at timestamp, graded_at timestamp, workflow_state string, late int, missing int, "
                   "excused int, attempt int, days_from_deadline double, updated_at timestamp",
    "quizzes": "quiz_id long, course_id long, title string, quiz_type string, points_possible double, "
               "due_at timestamp, published int, question_count int, updated_at timestamp",
    "quiz_submissions": "quiz_submission_id long, quiz_id long, user_id long, attempt int, score double, "
                        "kept_score double, workflow_state string, started_at timestamp, finished_at timestamp, "
                        "updated_at timestamp",
    "sync_runs": "run_id long, course_id long, started_at timestamp, finished_at timestamp, status string, "
                 "error_message string, courses_synced int, users_synced int, enrollments_synced int, "
                 "assignments_synced int, submissions_synced int, quizzes_synced int, quiz_submissions_synced int, "
                 "student_summaries_synced int, attempt int",
    "feed_rejects": "feed string, reason string, page string, record string, parsed string",
    "gate_calendar": "gate_id long, gate_name string, week_number int, gate_date date, description string",
    "student_summaries": "user_id long, page_views int, max_page_views int, participations int, "
                         "max_participations int, tardiness_on_time int, tardiness_late int, "
                         "tardiness_missing int, tardiness_floating int, tardiness_total int, pulled_at timestamp",
    "course_activity": "activity_id long, activity_date date, views int, participations int",
    "flag_events": "flag_id long, user_id long, flagged_at timestamp, flag_type string, reason string, "
                   "inputs string, resolved int",
    "email_log": "email_id long, user_id long, sent_at timestamp, flag_id long, approved_by string, opened int, "
                 "clicked int, reopened_canvas int",
    "student_risk_signals": "user_id long, avg_days_from_deadline double, timing_trend string, "
                            "days_since_last_login int, total_submissions int, zero_submissions int, "
                            "engagement_ratio double, gate_approaching int, gate_name string, days_until_gate int, "
                            "computed_at timestamp",
    # stored parts of the signals: sums of hundredths of days, and the enrollment that counts
    "learner_timing": "user_id long, n long, total long, first_total long",
    "learner_courses": "user_id long, final_score double, current_score double, last_activity_at timestamp, enrollment_id long",
    "student_pii": "user_id long, full_name string, email string, person_reference_id string, prefix string, "
                   "most_recent_role string, most_recent_employer string, loaded_at timestamp",
    "nudge_events": "nudge_id long, draft_id string, computation_id long, rendered_template string, "
                    "langsmith_run_id string, user_id long, nudge_type string, flag_code string, "
                    "template_id string, variant_id string, channel string, delivery_status string, subject string, "
                    "html_body string, to_email string, reviewer_id string, review_notes string, "
                    "delivered_at timestamp, provider_message_id string, created_at timestamp",
}

# --- fixed values: demographics export header -> column ----------------------
PII_HEADERS = {
    "Name": "full_name",
    "Email": "email",
    "Person Reference ID": "person_reference_id",
    "Person Prefix": "prefix",
    "Most recent role": "most_recent_role",
    "Most recent employer": "most_recent_employer",
}
DEMOGRAPHIC_HEADERS = {
    "Intake/Cohort/Term of entry": "cohort",
    "Person Age group": "age_group",
    "Person Country of origin": "country_of_origin",
    "Person Employment status": "employment_status",
    "Person Highest education level": "highest_education_level",
    "Field of Study": "field_of_study",
    "University / Institution": "university",
    "Person Primary language of education": "primary_language",
    "Person Sex": "sex",
    "Person Immigration status": "immigration_status",
    "Computer Programming": "skill_programming",
    "Days per week for the course": "days_per_week",
    "GenAI tools and applications": "skill_genai",
    "Have regular and reliable internet": "has_reliable_internet",
    "GenAI – Applied?": "genai_applied",
    "GenAI – Application context": "genai_application_context",
    "Hours per week": "hours_per_week",
    "Maths: Vectors & Matrices": "skill_vectors_matrices",
    "ML Tools and Applications": "skill_ml_tools",
    "Probability and Statistics": "skill_probability_stats",
    "Programming languages most used": "programming_languages_used",
    "Regular & reliable access to laptop/desktop": "has_laptop_access",
    "GenAI – Where learned (category)": "genai_where_learned",
    "Vectors & Matrices – Where learned (category)": "vectors_where_learned",
    "ML – Where studied (category)": "ml_where_studied",
    "ML – Where applied (category)": "ml_where_applied",
    "Probability & Statistics – Where learned (category)": "probstats_where_learned",
}
_TABLES["student_demographics"] = (
    "user_id long, " + ", ".join(f"{c} string" for c in DEMOGRAPHIC_HEADERS.values()) + ", loaded_at timestamp"
)

_FEEDS: dict[str, str] = {
    "users": "id long, email string, sis_user_id string, login_id string",
    "assignments": "id long, name string, due_at string, points_possible double",
    "enrollments": "id long, user struct<id: long>, type string, role string, enrollment_state string, "
                   "last_activity_at string, total_activity_time int, "
                   "grades struct<current_score: double, final_score: double>, created_at string, updated_at string",
    "student_summaries": "id long, page_views int, max_page_views int, participations int, max_participations int, "
                         "tardiness_breakdown struct<on_time: int, late: int, missing: int, floating: int, total: int>",
    "submissions": "id long, assignment_id long, user_id long, score double, grade string, submitted_at string, "
                   "graded_at string, workflow_state string, late string, missing string",
    "quizzes": "id long, title string, quiz_type string, points_possible double, due_at string, published string, "
               "question_count int",
    "quiz_submissions": "id long, user_id long, score double, kept_score double, attempt int, "
                        "workflow_state string, started_at string, finished_at string, "
                        "quiz_submissions array<struct<id: long, user_id: long, score: double, kept_score: double, "
                        "attempt: int, workflow_state: string, started_at: string, finished_at: string>>, "
                        "quiz_id long",
    "course_activity": "date string, views int, participations int",
    "decisions": "decision_id long, draft_id string, action string, reviewer_id string, notes string, "
                 "decided_at timestamp",
    "outcomes": "draft_id string, ok boolean, message_id string, error string",
}

TABLES: dict[str, str] = _TABLES
FEEDS: dict[str, str] = _FEEDS


@cache
def table_schema(name: str) -> StructType:
    """Schema of a table; parsing DDL needs a running session."""
    return StructType.fromDDL(TABLES[name])
