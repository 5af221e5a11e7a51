"""Readers that turn exports, SQL folders and rubrics into DataFrames."""
