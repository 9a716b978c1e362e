"""Shared plan building blocks: durable cut points, checked broadcasts, distributed ordering."""
