"""Whole plans: batches of questions to answers, and their evaluation."""
