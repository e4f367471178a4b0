"""Inputs and outputs of image relations."""
