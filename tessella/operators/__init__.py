"""Operators over the domain tables, one public function each."""
