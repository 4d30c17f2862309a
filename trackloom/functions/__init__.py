"""Part of trackloom; see the README for the layout."""
