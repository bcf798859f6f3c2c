"""Importing this module registers every query."""

from catalog import a_files, b_survival, c_cohort, d_describe, e_folds, f_selection, g_search, h_metrics, m_models, r_runs  # noqa: F401
