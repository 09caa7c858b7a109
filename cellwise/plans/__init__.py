"""Fluent histogram builders."""
