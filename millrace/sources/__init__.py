"""Readers: files of many makes as DataFrames, and checks on what they hold."""
