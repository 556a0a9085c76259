"""Instruction arms, and plans of steps as nested tables."""
