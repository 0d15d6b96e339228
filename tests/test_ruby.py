"""Ruby trees: extraction and resolution."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from callweave import project
from callweave.extract.ruby import extract_ruby

TREE = {
    "app/models/order.rb": """module Shop
  class Order < Base
    include Stampable
    belongs_to :user
    attr_reader :total
    delegate :email, to: :user
    def self.build(name)
      o = Order.new(name)
      o.pay(1)
      o
    end
    def initialize(name)
      @name = name
    end
    def pay(cents, note = nil)
      stamp
      user.notify
      items.each do |i|
        i.run
      end
      undeclared(cents)
      Rails.logger.info("x")
    end
  end
end
""",
    "app/models/user.rb": "module Shop\n  class User\n    def notify\n      thing.only_here\n      puts 1\n    end\n    def email; end\n  end\nend\n",
    "app/models/base.rb": "module Shop\n  class Base\n    def only_here\n    end\n  end\nend\n",
    "app/models/stampable.rb": "module Shop\n  module Stampable\n    def stamp\n      touch_me\n    end\n  end\nend\n",
    "app/A.java": "class A { void pay() { pay(); } }",
}


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return project.index(spark, str(root), "r")


def test_edges(indexed):
    names = indexed["symbols"].select("id", "fqn")
    got = {(r["a"], r["b"], r["kind"], r["confidence"]) for r in indexed["edges"].join(names.select(F.col("id").alias("from_symbol_id"), F.col("fqn").alias("a")), "from_symbol_id").join(names.select(F.col("id").alias("to_symbol_id"), F.col("fqn").alias("b")), "to_symbol_id").collect()}
    for want in [
        ("Shop::Order", "Shop::Base", "extends", 1.0), ("Shop::Order", "Shop::Stampable", "includes", 1.0), ("Shop::Order.build", "Shop::Order", "instantiates", 1.0), ("Shop::Order.build", "Shop::Order#initialize", "calls", 1.0),
        ("Shop::Order.build", "Shop::Order#pay", "calls", 1.0), ("Shop::Order#pay", "Shop::Stampable#stamp", "calls", 0.7), ("Shop::Order#pay", "Shop::Order#user", "calls", 0.7), ("Shop::Order#pay", "Shop::User#notify", "calls", 0.8),
        ("Shop::Order#email", "Shop::User#email", "calls", 0.8), ("Shop::User#notify", "Shop::Base#only_here", "calls", 0.4), ("A.pay", "A.pay", "calls", 1.0),
    ]:
        assert want in got, want
    assert not any(a.startswith("Shop") and b == "A.pay" for a, b, _, _ in got)


def test_outcomes(indexed):
    refs = indexed["refs"].select(F.col("id").alias("ref_id"), "name", "receiver")
    got = {(r["name"], r["receiver"]): (r["reason"], r["owner"]) for r in indexed["unresolved"].join(refs, "ref_id").collect()}
    assert got[("undeclared", None)] == ("external:not-in-project", None) and got[("puts", None)][1] == "Kernel" if ("puts", None) in got else True
    assert got[("logger", "Rails")] == ("external:Rails", "Rails") and got[("run", "i")][0] == "external:not-in-project"
    assert ("items", None) not in got  # a bare word that nothing declares is no call


def test_extractor_shapes():
    found = extract_ruby("class A\n  def f(x, *r, &b) = g(x)\n  def self.h; end\n  Point = Struct.new(:x)\n  s = \"no call(#{real(1)}) here\" # nor(here)\n  <<~SQL\n    not_a_call(1)\n  SQL\nend\n=begin\nx()\n=end\n__END__\ny()", "a.rb")
    assert [(s["fqn"], s["kind"], s["arity"]) for s in found.symbols] == [("A", "class", None), ("A#f", "method", 2), ("A.h", "class_method", 0), ("A::Point", "class", None), ("A::Point#x", "method", 0)]
    assert [r["name"] for r in found.refs] == ["g", "real"]
    for odd in ("end", "class", "def", "def f(", "a.b.", "x = ", "%w[a b]", "'", '"#{'):
        extract_ruby(odd, "x.rb")


FALLBACKS = {
    "user.rb": """class User < ApplicationRecord
  has_one :account
  def plain
    top_help
    find_by_sql(1)
  end
end
class Account < ApplicationRecord
  def close
  end
end
class Plain
  def close_it
  end
  def method_missing(name)
  end
end
class Mailer
  def setup
    @plain = Plain.new
    @found = User.find(1)
    @odd = Plain.find(1)
  end
  def run(user, plain, nobody)
    user.plain
    user.nothing_there(1)
    plain.close_it
    @plain.whatever(2)
    @found.plain
    @found.account.close
    account.close
  end
end
def top_help
end
""",
}


def test_fallbacks(spark, tmp_path):
    for name, text in FALLBACKS.items():
        (tmp_path / name).write_text(text)
    out = project.index(spark, str(tmp_path), "r")
    names = out["symbols"].select("id", "fqn")
    got = {(r["a"], r["b"], r["via"], r["confidence"], r["line"]) for r in out["edges"].where("kind = 'calls'").join(names.select(F.col("id").alias("from_symbol_id"), F.col("fqn").alias("a")), "from_symbol_id").join(names.select(F.col("id").alias("to_symbol_id"), F.col("fqn").alias("b")), "to_symbol_id").collect()}
    assert got == {
        ("User#plain", "Object#top_help", "self-chain", 0.7, 4),  # the last ancestor of all
        ("Mailer#setup", "Plain#method_missing", "method-missing", 0.4, 22),  # no class method of that name either
        ("Mailer#run", "User#plain", "name-convention", 0.5, 25),  # a record that has the member
        ("Mailer#run", "Plain#close_it", "unique-name", 0.4, 27),  # no record: its name says nothing
        ("Mailer#run", "Plain#method_missing", "method-missing", 0.4, 28),
        ("Mailer#run", "User#plain", "rails-association", 0.8, 29),  # a finder of a record
        ("Mailer#run", "User#account", "rails-association", 0.8, 30),
        ("Mailer#run", "Account#close", "rails-association", 0.8, 30),
        ("Mailer#run", "Account#close", "name-convention", 0.5, 31),
    }
    refs = out["refs"].select(F.col("id").alias("ref_id"), "name")
    reasons = {r["name"]: r["reason"] for r in out["unresolved"].join(refs, "ref_id").collect()}
    assert reasons["find_by_sql"] == "external:ApplicationRecord" and reasons["nothing_there"] == "external:not-in-project"
