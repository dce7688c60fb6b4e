"""Exam-paper corpus analytics on Spark."""
