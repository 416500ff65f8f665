"""Wikitext: template expansion and reduction to plain text, as pure functions used inside Arrow passes."""
