"""Readers and writers of requests, tasks, models and reports."""
