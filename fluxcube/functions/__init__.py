"""Scalar building blocks: missing values, units and warming potentials, codes."""
