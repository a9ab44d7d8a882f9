"""Operators over long tables of bars."""
